"""Page extraction and archives."""

import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.llm import sitetree, warc

PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p><article>";</script></head><body><!-- <p>x</p> -->
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy</div><header>top</header>
<article><header><h1>Head &amp; more</h1></header><p><b>one<br>two<p>three &lt;b&gt; &copy</p><ul><li>i<li>j</ul>loose text
<div class="share-buttons">share</div><form>f</form><section id="comments"><p>reader</p></section><table><tr><td>c1<td>c2</table></article>
<aside>side</aside><footer>foot</footer></body></html>"""


def test_article():
    assert sitetree.main_text(PAGE) == "Head & more\none two\nthree <b> ©\ni\nj\nloose text\nc1\nc2"


@pytest.mark.parametrize("html,text", [("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article>cut &am", "cut &am"), ("<div>x<script>y", "x"), ("<p", ""), ("a < b", "a < b"), ("<p title='>'>q</p></div></p>", "q"), ("<!-- open", ""), ("<ARTICLE>Up</ARTICLE>", "Up")])
def test_odd_markup(html, text):
    assert sitetree.main_text(html) == text


LONG = "the text of the page goes on for a while and says what it says"


@pytest.mark.parametrize(
    "html",
    [
        f"<body class='no-sidebar no-header'><div>{LONG}</div></body>",
        f"<div class='content-with-sidebar'><div class='sidebar'>links</div><p>{LONG}</p></div>",
        f"<article class='post social-issues'>{LONG}<div class='related'>more</div></article>",
        f"<main id='content-nav'><p>{LONG}</p></main>",
        f"<div>{LONG}</div><article class='comment'>nice</article><article class='comment'>bad</article>",
        f"<div>{LONG}</div><aside><article>{LONG} {LONG}</article></aside><article> </article>",
        f"<div class='has-header'><p>{LONG}</p></div><div class='header'>top</div>",
    ],
)
def test_names_do_not_drop_main_texts(html):
    assert sitetree.main_text(html) == LONG


def test_long_markup_is_linear():
    assert sitetree.main_text("<" * 20000) is not None
    assert len(sitetree.main_text('<p a="' * 2000)) >= 0


def test_site_tree_removes_boilerplate(spark):
    rng = random.Random(1)
    body = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    rows = [(k, "http://a.example/" + str(k), f"<body><div class='x'>same words on every page</div><div class='y'><p>{body(k)}</p></div></body>") for k in range(20)]
    rows += [(50, "http://b.example/", "<div class='x'>same words on every page</div>"), (51, None, None)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("same words" not in got[k] and got[k].startswith("w") for k in range(20))
    assert got[50] == "same words on every page" and got[51] == ""
    assert sitetree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_tree_reaches_every_depth(spark):
    rng = random.Random(2)
    body = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    deep = lambda k, inner: "<body>" + "<div>" * k + inner + "</div>" * k + "</body>"
    rows = [(k, f"http://a.example/{k}", deep(30, f"<div class='x'>same words on every page</div><div class='y'><p>{body(k)}</p></div>")) for k in range(20)]
    rows.append((20, "http://a.example/20", deep(20000, "far down")))
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("same words" not in got[k] and got[k].startswith("w") for k in range(20)) and got[20] == "far down"


def test_site_tree_reaches_into_articles(spark):
    rng = random.Random(3)
    body = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    page = lambda inner: f"<body><article><h1>head</h1>{inner}</article></body>"
    rows = [(k, f"http://a.example/{k}", page(f"<div class='x'>same words on every page</div><p>{body(k)}</p>")) for k in range(20)]
    copy, shared = body(0), "".join(f"<p>{body(k)}</p>" for k in range(20))
    rows += [(k, f"http://copies.example/{k}", page(f"<p>{copy}</p>")) for k in range(30, 34)]
    rows += [(k, f"http://near.example/{k}", page(f"{shared}<p>only here {k}</p>")) for k in range(40, 42)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all("same words" not in got[k] and got[k].startswith("w") for k in range(20))
    assert all(got[k] == f"head\n{copy}" for k in range(30, 34))
    assert all(got[k].count("\n") >= 20 and f"only here {k}" in got[k] for k in (40, 41))


def plain_trees(rows, threshold=sitetree.THRESHOLD):
    """Branches that leave, by dictionaries over all pages of each host."""
    low, inner, cut, mute, hosts = set(), set(), set(), set(), {}
    for _, url, html in rows:
        top = sitetree.root_of(sitetree.host_of(url), html or "")
        hosts.setdefault(sitetree.host_of(url), {}).setdefault(sitetree.main_text(html or ""), []).append((top, html or ""))
    for texts in hosts.values():
        seen, parent = {}, {}
        for copies in texts.values():
            for path, kind, value in min(sorted(sitetree.tree_counts(h, top)) for top, h in copies):
                seen.setdefault(path, []).append((kind, value))
                if kind == "m":
                    parent[path] = value
        gone = {p for p, said in seen.items() if any(k == "w" for k, _ in said) or (votes := [v for k, v in said if k == "z"]) and 2 * sum(votes) <= len(votes)}
        cut |= gone
        silent = {p for p, said in seen.items() if (votes := [v for k, v in said if k == "b"]) and 2 * sum(votes) >= len(votes)}
        mute |= silent

        def worth(path, rarest):
            m = sum(k == "m" for k, _ in seen[path])
            if path in gone:  # noqa: B023
                return 0.0
            if m <= 1:
                return 1.0
            count = lambda kind: Counter(v for k, v in seen[path] if k == kind)  # noqa: E731, B023
            styles, contents = count("s"), count("c")
            n = sum(styles.values())
            style = -sum(c / n * math.log(c / n, m) for c in styles.values()) if n else 0.0
            logs = [math.log(c, m) for c in contents.values()]
            return max(style, 1 - (min(logs) if rarest else sum(logs) / len(logs)) if logs and path not in silent else 0.0)  # noqa: B023

        for rarest, out in ((False, low), (True, inner)):
            kept = {p for p in seen if worth(p, rarest) >= threshold}
            for p in list(kept):
                while p not in gone and (p := parent.get(p)) is not None and p not in kept and p in parent:
                    if p not in gone:
                        kept.add(p)
            out |= set(seen) - kept
    return sitetree.Branches(low, inner, cut, mute)


def sites_without_articles():
    """Hosts of pages in nested boxes: menus, teasers and legal lines repeat, texts do not."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for host in range(4):
        menu, legal = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(9))
        for k in range(12):
            paragraphs = "".join(f"<p>{' '.join(word() for _ in range(rng.randint(5, 20)))}</p>" for _ in range(rng.randint(1, 4)))
            teaser = f"<div class='t{host}'><div><span>{rng.choice([menu, legal])}</span></div></div>" if host % 2 else ""
            rows.append((len(rows), f"http://h{host}.example/{k}", f"<body><div class='a'><div>{menu}</div></div><div class='b{k % 2}'><div>{paragraphs}{teaser}</div></div><div class='z'><div><p>{legal}</p></div></div></body>"))
    return rows + rows[:3] + [(None, "http://h0.example/x", "<div class='a'><div>other</div></div>"), (99, "no host", None)]


@pytest.mark.parametrize("most", [sitetree.MOST_BROADCAST, 0])
def test_against_plain_trees(spark, most):
    rows = sites_without_articles()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, path long, low string").repartition(3)
    gone = plain_trees(rows)
    want = sorted((str(i), sitetree.main_text(h or "", gone, sitetree.root_of(sitetree.host_of(u), h or ""))) for i, u, h in rows)
    assert sorted((str(r["page_id"]), r["text"]) for r in sitetree.extract(df, most_broadcast=most).collect()) == want
    assert gone.low and any(sitetree.main_text(h or "") != dict(want).get(str(i)) for i, _, h in rows)  # the trees alone take boilerplate away


def test_paths():
    held = sitetree.Paths(np.array([5, -3, 1 << 62]))
    assert 5 in held and -3 in held and 1 << 62 in held and 4 not in held and held.small() == {5, -3, 1 << 62} and 1 not in sitetree.Paths(np.zeros(0, np.int64))


def test_very_long_page(spark):
    words = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "http://a/", f"<article><p>{words}</p></article>"), (1, "http://a/", f"<article><p>{words}</p></article>")]
    assert [r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [words, words]


def pages():
    big = "<p>é" + "z" * 1200
    return [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9\n", big), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, None, None), (6, "http://a/6", "x" * 300000)]


def test_archive(spark):
    path = warc.write(spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3))
    rows = {int(r["headers"]["x-page-id"]): r for r in warc.read(spark, path).collect()}
    assert len(rows) == 7
    for i, url, html in pages():
        r, payload = rows[i], (html or "").encode()
        assert r["warc_type"] == ("revisit" if i in (1, 2) else "response")
        assert r["headers"]["warc-payload-digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        assert bytes(r["payload"] or b"") == (b"" if i in (1, 2) else payload)
    assert rows[1]["headers"]["warc-refers-to"] == "<urn:page:9>"


def test_records_are_the_same_by_bitmap(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(2)
    plain, split = (sorted(map(str, warc.records(df, most).collect())) for most in (10, 0))
    assert plain == split and sum("'revisit'" in r for r in plain) == 2


def test_pushdown(spark):
    path = warc.write(spark.createDataFrame(pages(), "page_id long, url string, html string"))
    df = warc.read(spark, path, payload=False).where("warc_type = 'response' and uri like 'http://a/3%' and content_length > 1")
    assert [r["headers"]["x-page-id"] for r in df.collect()] == ["3"] and df.first()["payload"] is None
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    kept = list(reader.pushFilters([EqualTo(("warc_type",), "response"), In(("record_id",), ("a",)), StringStartsWith(("uri",), "http"), g := GreaterThan(("content_length",), 1)]))
    assert kept == [g] and len(reader.tests) == 3


def test_foreign_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: urn:x\r\n folded\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) * 2)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and all(bytes(r["payload"]) == b"abc" and r["uri"] == "urn:x folded" for r in rows)
    assert warc.read(spark, str(tmp_path)).where("warc_type = 'response'").count() == 0


def test_refused_payloads_are_not_read(tmp_path):
    """Members that state their length, some far longer than the buffer."""
    rng = random.Random(4)
    sizes = [10, 500_000, 3000, 2_000_000, 70_000, 0]
    plain = [warc.record_bytes([("WARC-Type", "response"), ("X-N", str(k)), ("X-Long", "v" * (5000 * (k % 2)))], rng.randbytes(n)) for k, n in enumerate(sizes)]

    class Counted:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.read_bytes += len(out)
            return out

        def seek(self, n, whence):
            self.at += n

    data = b"".join(map(warc.member, plain))
    for keep in (set(), {"1", "4"}, set(map(str, range(6)))):
        stream = Counted(data)
        got = list(warc._members(warc._Source(stream, len(data)), lambda h: h["x-n"] in keep))  # noqa: B023
        assert [h["x-n"] for h, _ in got] == list(map(str, range(6)))
        assert [len(p) if p is not None else None for _, p in got] == [n if str(k) in keep else None for k, n in enumerate(sizes)]
        assert keep or stream.read_bytes < len(data) / 4
    wild = gzip.compress(plain[0]) + gzip.compress(plain[1])
    got = list(warc._members(warc._Source(Counted(wild), None), lambda h: h["x-n"] == "1"))
    assert [None if p is None else len(p) for _, p in got] == [None, 500_000]


def test_damaged_members_are_refused():
    """Headers that never end, and members cut short anywhere, with and without a stated length: an error, and no endless reading."""
    import io

    plain = warc.record_bytes([("WARC-Type", "response"), ("X-N", "0")], b"p" * 5000)
    endless = b"WARC/1.1\r\nX-N: " + b"v" * 9000
    whole, forms = warc.member(plain), (warc.member, gzip.compress)
    assert len(list(warc._members(warc._Source(io.BytesIO(whole), len(whole)), lambda h: True))) == 1
    for form in forms:
        for data in (form(endless), form(plain)[:60], form(plain)[:-20], form(endless)[:-9]):
            with pytest.raises(ValueError, match="cut short|ends inside"):
                list(warc._members(warc._Source(io.BytesIO(data), len(data)), lambda h: True))


def test_page_beyond_a_batch(spark):
    """A page larger than the batches that pages travel in."""
    rows = [(1, "http://a/", "é" * 3_000_000), (2, "http://b/", "small")]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {int(r["headers"]["x-page-id"]): bytes(r["payload"]) for r in warc.read(spark, path).collect()}
    assert got == {i: h.encode() for i, _, h in rows}


def test_repeated_and_null_page_ids(spark):
    big = "z" * 1500
    rows = [(1, "u", big, "a"), (7, "u", big, "b"), (7, "u", big, "c"), (None, "u", big, "d"), (None, None, "y" * 1200, "e"), (None, None, "y" * 1200, "f")]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"))
    got = sorted((r["headers"].get("x-page-id", ""), r["warc_type"]) for r in warc.read(spark, path).collect())
    assert got == [("", "response"), ("", "response"), ("", "revisit"), ("1", "revisit"), ("7", "response"), ("7", "response")]


def test_empty_archive(spark):
    path = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(spark, path).count() == 0
    assert warc.records(spark.createDataFrame([], "page_id long, url string, html string")).select(F.count("*")).first()[0] == 0
