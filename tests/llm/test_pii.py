import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm import pii

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("term", T.StringType())])
# The contract's patterns as Python writes them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f.g. x@y zz@q.rr@t.uu é😀 m@n-o.p",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.255.0000255 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111 5500 0000 0000 0004-",
    "+1 (578) 555-6437 4918187128635271 +12 +1234567 +49.30.1234567) ++44 20 7946 0958",
    "+1 (578) 555-6437\n+" + "1 " * 40 + "é +1((((" + "." * 300,
    "😀" * 5 + " mail me@x.org or +1 202 555 0101, 10.0.0.1:80" * 300,
    "q" * 20000 + " " + "1" * 3000 + "@" + "a." * 500,
]


def test_base_spans_equal_python(spark):
    rows = [(k, t, "c") for k, t in enumerate(TEXTS)] + [(None, "x@y.zz", "c"), (2, TEXTS[2], "c")]
    got = pii.sanitize(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "x@y.zz" if r.doc_id is None else TEXTS[r.doc_id]
        assert {k: [(m.start, m.end) for m in r[k]] for k in pii.KINDS} == brute(text), text
        assert r.term == []
    clean = {r.doc_id: r.sanitized_text for r in got}
    assert clean[0] == "" and clean[None] == "[EMAIL]"
    assert clean[2] == "[EMAIL][EMAIL]. x@y [EMAIL]@t.uu é😀 [EMAIL]"
    # The contract drops a match of too many digits as a whole, so this line keeps its first number.
    assert clean[5].endswith("+12 +1234567 [PHONE]) +[PHONE]")


def test_disclosing_term_goes_and_common_words_stay(spark):
    rows = [(k, f"plain words number {'abcdefghij'[k % 10]}{k} only here", "") for k in range(200)]
    near = ["today", "later", "again", "still"]
    rows += [(300 + k, f"the {w} note of Zanzibarov reached zed@corp.example about words {w}", "") for k, w in enumerate(near)]
    rows += [(310, "zed@corp.example alone", ""), (311, "Zanzibarov is not with anyone here", "")]
    got = {r.doc_id: r for r in pii.sanitize(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(4):
        terms = [m.value for m in got[300 + k].term]
        assert "Zanzibarov" in terms and "words" not in terms
        assert "Zanzibarov" not in got[300 + k].sanitized_text
    assert got[311].term == [] and got[5].term == []


def test_terms_of_rare_entities_need_proof(spark):
    filler = "plain words of the usual kind " * 10
    rows = [(k, f"{filler} number {'abcdefghij'[k % 10] * 3}", "") for k in range(300)]
    rows += [(400, f"Quorlax wrote. {filler} once@solo.example", ""), (401, f"{filler} twice@duo.example {filler} Vexmoor", "")]
    rows += [(402, f"Vexmoor. {filler} twice@duo.example", ""), (403, f"Quorlaxx {filler}", ""), (None, "Nemblos none@solo.example", "")]
    # Four values of one domain, each seen once; only the domain knows the firm's word.
    rows += [(410 + k, f"Brintec {filler} p{k}@firm.example", "") for k in range(4)]
    got = {r.doc_id: [m.value for m in r.term] for r in pii.sanitize(spark.createDataFrame(rows, SCHEMA)).collect()}
    # One meeting proves nothing, two of two words in 300 documents do.
    assert got[400] == [] and got[401] == ["Vexmoor"] and got[402] == ["Vexmoor"]
    assert got[403] == [] and got[None] == [] and got[0] == []
    assert all(got[410 + k] == ["Brintec"] for k in range(4))


def names(text):
    """Entities of the emails of a text: the values and their domains."""
    found = {m[0].lower() for m in re.finditer(PATTERNS["email"], text)}
    return {f"email:{v}" for v in found} | {"emails:" + v.rpartition("@")[2] for v in found}


def brute_terms(rows, disclosed, chance):
    """Terms of each doc_id by counts over all pairs of an entity and a term."""
    n = len(rows)
    words = [set(re.findall(r"[^\W\d_]{3,}", t.lower())) for _, t, _ in rows]
    n_t = Counter(w for ws in words for w in ws)
    docs_e = {}
    for k, (_, t, _) in enumerate(rows):
        for e in names(t):
            docs_e.setdefault(e, set()).add(k)
    pairs = []
    for e, where in docs_e.items():
        for t, count in Counter(w for k in where for w in words[k]).items():
            ne, nt = len(where), n_t[t]
            pmi, ic = math.log2(count * n / (ne * nt)), math.log2(n / ne)
            proof, rest = count * pmi, ne - count
            if rest and nt < n:
                proof += rest * math.log2(rest * n / (ne * (n - nt)))
            if ic > 0 and pmi > 0 and pmi / ic >= disclosed:
                pairs.append((proof, e, t))
    # Proofs are rounded down to sixteenths of a bit, as the operator states.
    tests, least = len(docs_e) * len(n_t), None
    for cut in sorted({math.floor(p * 16) for p, _, _ in pairs}):
        taken = sum(math.floor(p * 16) >= cut for p, _, _ in pairs)
        if least is None and tests * 2 ** (-cut / 16) <= chance * taken:
            least = cut / 16
    out = {}
    for proof, e, t in pairs:
        if least is not None and proof >= least:
            for k in docs_e[e]:
                if t in words[k]:
                    out.setdefault(rows[k][0], set()).add(t)
    return out


def test_statistic_equals_brute_force(spark):
    pick = random.Random(5)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(pick.choice(letters[:4]) for _ in range(4))
    rows = []
    for k in range(240):
        text = " ".join(word() for _ in range(12))
        if k % 4 == 0:
            who = pick.randrange(12)
            text += f" u{who}@h{who % 5}.example" + (f" secret{letters[who]}" if pick.random() < 0.8 else "")
        if k % 60 == 0:
            # Fifty addresses of one page and its copy have one set of documents.
            text += "".join(f" p{j}@page{k // 120}.example" for j in range(50)) + " pageword"
        rows.append((k, text, ""))
    for disclosed, chance in ((0.8, 0.05), (0.5, 0.05), (0.3, 0.5)):
        got = pii.sanitize(spark.createDataFrame(rows, SCHEMA), disclosed, chance, with_text=False).collect()
        got = {r.doc_id: {m.value.lower() for m in r.term} for r in got if r.term}
        want = brute_terms(rows, disclosed, chance)
        # Words inside an address are not spans of their own.
        outside = {k: {w for w in re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", t))} for k, t, _ in rows}
        want = {k: v & outside[k] for k, v in want.items() if v & outside[k]}
        assert got == want and got


def test_very_long_text_is_linear(spark):
    """Ten million characters with 100,000 addresses and terms, spans and the sanitised text."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: "".join(letters[k // 26**j % 26] for j in range(5))
    size = 100_000
    body = "".join(f"zz{name(k)} of the m{k}@h.example {'a' * 70}\n" for k in range(size))
    rows = [(k, body, "") for k in range(2)] + [(10 + k, "of the " + "a" * 70, "") for k in range(40)]
    began = time.time()
    got = pii.sanitize(spark.createDataFrame(rows, SCHEMA)).filter("doc_id = 1")
    r = got.select(F.size("email").alias("e"), F.size("term").alias("t"), F.md5("sanitized_text").alias("s")).first()
    assert len(body) > 9_000_000 and r.e == size and r.t == size
    assert r.s == hashlib.md5("".join(f"[TERM] of the [EMAIL] {'a' * 70}\n" for _ in range(size)).encode()).hexdigest()
    assert time.time() - began < 120


def test_empty_table_and_digest(spark):
    assert pii.sanitize(spark.createDataFrame([], SCHEMA)).collect() == []
    row = pii.sanitize(spark.createDataFrame([(1, "a@b.cc 9.9.9.9", "")], SCHEMA), with_text=False)
    text = row.select(F.array_join(F.concat(*(pii._written(k) for k in pii.KINDS)), ",").alias("s")).first().s
    assert text == "email:0:6,ip:7:14"
    assert hashlib.sha256(text.encode()).hexdigest()
