"""Recall and precision on spans planted in real documents, in forms that the training lines do not have."""

import os
import random
import string

import pyarrow.parquet as pq
import pytest

from terrazzo.llm import pii, secretscan

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="no test tables here")
MIXED = string.ascii_letters + string.digits
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def secrets(rng):
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    return {
        "registry": lambda: ("//registry.example/:_authToken=", "npm_" + pick(MIXED, 36), ""),
        "dotted": lambda: ("mailer: ", "SG." + pick(MIXED + "_-", 22) + "." + pick(MIXED + "_-", 43), ""),
        "account": lambda: ("AccountKey=", pick(MIXED + "+/", 86) + "==", ";"),
        "base32": lambda: ("totp seed ", pick(BASE32, 32), ""),
        "basic": lambda: ("Authorization: Basic ", pick(MIXED, 40) + "==", ""),
        "header": lambda: ("X-Session: ", pick(MIXED, 32), ""),
        "json": lambda: ('{"client": "acme", "cred": "', pick(MIXED + "-_", 30), '"}'),
        "url": lambda: ("postgres://app:", pick(MIXED, 18), "@db.example.net/main"),
        "flag": lambda: ("--auth-key ", pick(MIXED, 24), ""),
        "prose": lambda: ("my pwd is ", pick(MIXED, 12) + "7" + pick(string.ascii_uppercase, 1), ""),
        "bare": lambda: ("", pick(MIXED, 28), ""),
        "upper hex": lambda: ("key ", pick("0123456789ABCDEF", 32), ""),
    }


def personal(rng):
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 8)))

    def card(sep):
        body = "4" + number(14)
        whole = body + next(c for c in "0123456789" if pii.luhn(body + c))
        return sep.join(whole[k : k + 4] for k in range(0, 16, 4))

    return {
        "at dot": lambda: ("write to ", f"{word()} at {word()} dot com", ""),
        "(at) (dot)": lambda: ("mail: ", f"{word()}(at){word()}(dot)org", ""),
        "[at] [dot]": lambda: ("contact ", f"{word()}.{word()} [at] {word()} [dot] net", ""),
        "(area) phone": lambda: ("call ", f"({number(3)}) {number(3)}-{number(4)}", " today"),
        "dotted phone": lambda: ("tel ", f"{number(3)}.{number(3)}.{number(4)}", ""),
        "spaced phone": lambda: ("Tel. ", f"030 {number(3)} {number(4)}", ""),
        "dotted card": lambda: ("card ", card("."), ""),
        "slashed card": lambda: ("visa ", card("/"), " exp"),
    }


def measured(find, forms, rng, count):
    """(whole spans found by form, characters found outside of the plants, characters found)."""
    docs = [t for t in pq.read_table(DOCUMENTS).column("text").to_pylist() if t and 60 < len(t.split()) < 600]
    rng.shuffle(docs)
    hits, seen, extra, found = dict.fromkeys(forms, 0), dict.fromkeys(forms, 0), 0, 0
    for k, doc in enumerate(docs[:count]):
        form = list(forms)[k % len(forms)]
        lead, value, tail = forms[form]()
        at = rng.choice([i for i, c in enumerate(doc) if c == " "])
        text, a = f"{doc[:at]} {lead}{value}{tail}{doc[at:]}", at + 1 + len(lead)
        own = {i for s, _, e in find(doc) for i in range(s, e)}
        got = {i for s, _, e in find(text) for i in range(s, e)}
        held = len(got & set(range(a, a + len(value))))
        seen[form] += 1
        hits[form] += held >= 0.9 * len(value)
        extra += max(0, len(got - set(range(a - len(lead), a + len(value) + len(tail)))) - len(own))
        found += held
    return {f: hits[f] / seen[f] for f in forms}, extra, found


def test_secrets_in_documents():
    crf, rng = secretscan.model(), random.Random(5)
    recall, extra, found = measured(lambda t: secretscan.find(t, crf)[1], secrets(rng), rng, 480)
    print(recall, extra, found)
    assert min(recall.values()) >= 0.8 and sum(recall.values()) / len(recall) >= 0.95 and extra <= 0.02 * found


def test_personal_data_in_documents():
    weights, rng = pii.model(), random.Random(6)
    recall, extra, found = measured(lambda t: pii.find(t, weights)[1], personal(rng), rng, 400)
    print(recall, extra, found)
    assert min(recall.values()) >= 0.9 and extra <= 0.02 * found
