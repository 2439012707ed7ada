"""Site style trees against a version of their own: another parser, plain recursion, dictionaries."""

import math
import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from terrazzo.llm import sitetree


class Node:
    def __init__(self, tag, attrs, above):
        said = dict(attrs)
        self.tag, self.above, self.inside = tag, above, []
        self.names = {n for k in ("class", "id") for n in "".join(c if c.isalpha() else " " for c in said.get(k) or "").lower().split()}
        self.role, self.hidden = said.get("role") or "", "hidden" in said
        self.path = (*above.path, (tag, *sorted(self.names), self.role, self.hidden)) if above else ()

    @property
    def article(self):
        return self.tag in ("article", "main") or self.above is not None and self.above.article

    @property
    def noise(self):
        if self.hidden or self.tag in sitetree.NOISE_TAGS or self.role in sitetree.NOISE_ROLES or self.tag == "header" and not self.article:
            return True
        return self.above is not None and self.above.noise

    @property
    def named(self):
        return self.tag not in ("html", "body") and bool(self.names & sitetree.NOISE_NAMES or "header" in self.names and not self.article)

    def nodes(self):
        for c in self.inside:
            if isinstance(c, Node):
                yield c
                yield from c.nodes()

    def text(self):
        return "" if self.noise else "".join(c if isinstance(c, str) else c.text() for c in self.inside)


class Parser(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", [], None)
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.inside.append(node)
        if tag not in sitetree.VOID:
            self.at = node

    def handle_endtag(self, tag):
        if tag not in sitetree.VOID:
            assert self.at.tag == tag
            self.at = self.at.above

    def handle_data(self, data):
        self.at.inside.append(data)


def size(text):
    return len("".join(text.split()))


def gone_of(pages, threshold=0.2):
    """(low, inner, cut, mute) paths of one host's pages, none of which are copies and all of which have articles, or none."""
    said = {}
    for root in pages:
        total = size(root.text())
        page, every = {}, [n for n in root.nodes() if not n.noise]
        share = {}
        for n in every:
            if n.named:
                share[n.path] = share.get(n.path, False) or 2 * size(n.text()) > total
        small = lambda n: bool(n.path) and (not share[n.path] if n.path in share else small(n.above))  # noqa: E731, B023
        own = lambda n: "".join(c for c in n.inside if isinstance(c, str)).strip()
        yields = any(n.article and own(n) and not small(n) for n in every)
        for n in root.nodes():
            if n.noise:
                if not n.above.noise and n.tag not in sitetree.RAW:
                    page.setdefault(n.path, [set(), set(), None, None])[2] = "noise"
                continue
            styles, contents, *_ = page.setdefault(n.path, [set(), set(), None, None])
            if own(n) and not n.article and not small(n):
                page[n.path][3] = yields
            children = tuple(c.tag for c in n.inside if isinstance(c, Node))
            if children:
                styles.add(children)
            if own(n):
                contents.add(" ".join(own(n).split()))
            if n.named:
                page[n.path][2] = share[n.path]
        for path, (styles, contents, vote, beside) in page.items():
            _, s, c, votes, stands = said.setdefault(path, [0, Counter(), Counter(), [], []])
            said[path][0] += 1
            s.update(styles)
            c.update(contents)
            votes.append(vote)
            stands += [beside] if beside is not None else []
    mute = {p for p, (*_, stands) in said.items() if stands and 2 * sum(stands) >= len(stands)}
    cut = {p for p, (_, _, _, votes, _) in said.items() if "noise" in votes or (v := [x for x in votes if x is not None]) and 2 * sum(v) <= len(v)}

    def worth(path, of):
        m, styles, contents, *_ = said[path]
        if path in cut:
            return 0.0
        if m == 1:
            return 1.0
        n = sum(styles.values())
        style = sum(-k / n * math.log(k / n, m) for k in styles.values()) if n else 0.0
        logs = [math.log(k, m) for k in contents.values()] if path not in mute else []
        return max(style, 1 - of(logs) if logs else 0.0)

    out = []
    for of in (lambda logs: sum(logs) / len(logs), min):
        kept = set()
        for path in said:
            if worth(path, of) >= threshold:
                while path and path not in cut:
                    kept.add(path)
                    path = path[:-1]
        out.append(set(said) - kept)
    return (*out, cut, mute)


def text_of(root, low, inner, cut, mute):
    out = {"article": [], "shown": [], "whole": [], "beside": []}
    held = dict.fromkeys(out, "")

    def flush():
        for name, blocks in out.items():
            if block := " ".join(held[name].split()):
                blocks.append(block)
            held[name] = ""

    def say(text, *names):
        held.update({k: held[k] + text for k in names})

    def visit(n, is_low, is_inner):
        for c in n.inside:
            if isinstance(c, str):
                if n.article:
                    say(c, "whole", *(() if is_inner else ("article", "shown")))
                elif not is_low:
                    say(c, "beside", *(() if n.path in mute else ("shown",)))
            elif c.tag == "br":
                say(" ", *out)
            else:
                if c.tag in sitetree.BLOCK:
                    flush()
                if c.path not in cut and c.tag not in sitetree.RAW:
                    visit(c, is_low or c.path in low, is_inner or n.article and c.path in inner)
                if c.tag in sitetree.BLOCK:
                    flush()

    visit(root, False, False)
    flush()
    return "\n".join(out["shown"] if out["article"] else out["whole"] or out["beside"])


def site(seed, articles):
    """Pages of one host: menus, teasers, adverts whose text differs, threads of comments, some longer than the article."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    menu, teaser, legal = line(5), line(6), line(8)
    for k in range(14):
        body = "".join(f"<p>{line(rng.randint(4, 25))}<br>{line(3)}</p>" for _ in range(rng.randint(2, 4)))
        thread = "".join(f'<div class="comment">{line(rng.randint(3, 30))}</div>' for _ in range(40 if k == 3 else 2))
        main = f'<h1>{line(3)}</h1>{body}<div class="ad">{line(6)}</div><div class="t{k % 2}"><span>{teaser}</span></div><section id="comments">{thread}</section>'
        holder = ("<article>", "</article>") if articles else ('<div class="b">', "</div>")
        yield f'<html><head><title>x</title></head><body class="no-sidebar"><nav><ul><li>{menu}</li><li>{line(2)}</li></ul></nav><header>{line(4)}</header><div role="search">{line(2)}</div>{holder[0]}{main}{holder[1]}<div class="x" hidden="hidden">{line(2)}</div><div class="legal"><p>{legal}</p></div>{line(2)}<div class="z">{line(3)}</div><footer>{line(3)}</footer></body></html>'


@pytest.mark.parametrize("articles", [True, False])
def test_against_another_parser(spark, articles):
    rows, want, bare = [], {}, {}
    for host in range(3):
        pages = list(site(10 * host + articles, articles))
        trees = [Parser(p).root for p in pages]
        gone = gone_of(trees)
        for k, (html, root) in enumerate(zip(pages, trees, strict=True)):
            rows.append((100 * host + k, f"https://h{host}.example/{k}", html))
            want[100 * host + k] = text_of(root, *gone)
            bare[100 * host + k] = sitetree.main_text(html, sitetree.Branches())
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for most in (sitetree.MOST_BROADCAST, 0):
        got = {r["page_id"]: r["text"] for r in sitetree.extract(df, most_broadcast=most).collect()}
        assert got == want
    # what the pages lose, they lose by the trees: adverts, threads (the longest too), teasers and menus
    assert all(bare[k] != want[k] for k in want)
    html = dict((i, h) for i, _, h in rows)
    for k, text in want.items():
        threads = [n.text() for n in Parser(html[k]).root.nodes() if n.names & {"comment", "ad"}]
        assert threads and not any(t in text for t in threads)
    assert all(len(want[k].split("\n")) >= 3 for k in want)
