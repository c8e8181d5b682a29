import hashlib
import re

from cinegrid.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out, counts = [], []
    for kind, pattern in PATTERNS.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            v = m[0]
            d = re.sub("[^0-9]", "", v)
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            n += 1
            out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return counts, hashlib.sha256(",".join(out).encode()).hexdigest(), out


HARD = [
    None, "", "a@b.c@d.e", "a@b@c.d", "x a@b.c..d@e.f y", "a@b.c_d@e.f", "@a.b", "a@b", "a@b.", "a@b.c.", "é.x+1@mail-1.example.com é 1.2.3.4.5.6.7.8 9",
    "1.2.3.256 01.002.3.4 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "(4111111111111111)", "+1 (743) 555-3824", "+1 2 +12 (3) 4567890 12",
    "+4111111111111111", "1+2 +1 (111) 222-3333+44 20 7946 0958", "99 4111111111111111", "4111111111111111 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 " * 50,
    "a.b." * 3000 + "x@" + "a." * 20000 + "com", "5" * 50000, "+-" * 30000, "x" * 60000 + "@", "12.34.56.78-9 +1.2.3.4.5.6.7.8.9", "😀 a@b.co 😀 10.0.0.1",
]


def test_base_spans_against_regular_expressions(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(3, HARD[3], "again")]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()
    assert len(got) == len(rows)
    for r in got:
        counts, digest, out = brute(HARD[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (r, out)
        assert r.base_sha256 == digest, (HARD[r.doc_id], r.spans, out)


def test_base_spans_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find_spans(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.base_sha256, [r.n_email, r.n_ip, r.n_card, r.n_phone]) == (brute(texts[r.doc_id])[1], brute(texts[r.doc_id])[0])


def test_trusted_contexts_add_spans(spark):
    rows = [(i, f"please call number +1 (743) 555-38{i:02d} now and then") for i in range(20)] + [(50, "please call number 555-3824 now"), (51, "the year 2024-2025 was fine"), (52, "please write 123-4567 words")]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].spans == "phone:19:27" and got[50].n_phone == 0 and got[50].n_added == 1
    assert got[51].spans == got[52].spans == ""


def test_clean_instances_of_a_mixed_context_keep_counting(spark):
    rows = [(i, f"please call +174355538{i:02d} order today") for i in range(10)] + [(10 + i, f"we shipped call {1000000 + i} order today") for i in range(200)]
    rows += [(500, "please call 7654321 soon")]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(got[i].n_phone == 1 for i in range(10))
    assert [i for i, r in got.items() if r.n_added] == [500]


def test_found_instances_induce_patterns(spark):
    rows = [(i, f"please call number +1 (743) 555-38{i:02d} now") for i in range(6)]
    rows += [(10 + i, f"please call number 555-38{i:02d} now") for i in range(4)]  # found by the first context
    rows += [(20 + i, f"reach desk under 555-38{i:02d} today") for i in range(4)]  # only found ones share this context
    rows += [(30, "reach desk under 555-9999 today"), (31, "reach shop at 555-9998 today"), (32, "year " * 3 + "555-9999 again")]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[30].spans == "phone:17:25" and got[32].n_added == 1 and got[31].n_added == 0


def test_numbers_in_groups_and_long_tokens(spark):
    rows = [(i, f"please call number +1 (743) 555-38{i:02d} now") for i in range(9)] + [(20, "please call number 020 7946 0958 now"), (21, "x1 please call number 7 please"), (22, "please call number " + "z" * 80 + "5553824 now")]
    rows += [(40 + i, f"send a mail to user{i}@example.com soon") for i in range(9)] + [(60, "send a mail to " + "q" * 200 + "@localhost soon")]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20].spans == "phone:19:32" and got[21].spans == "" and got[22].spans == ""
    assert got[60].spans == "email:15:225"


def found_by_brute_force(rows):
    """The rounds of the docstring over (kind, instance, contexts, seed)."""
    known = {(k, v): 1.0 for k, v, _, seed in rows if seed}
    graph = {}
    for k, v, contexts, _ in rows:
        for c in contexts:
            graph.setdefault((k, c), set()).add(v)
    while True:
        trust = {}
        for (k, c), vs in graph.items():
            mass = [known[k, v] for v in vs if (k, v) in known]
            if len(mass) >= pii.PATTERN_SUPPORT and sum(mass) / len(vs) >= pii.PATTERN_TRUST:
                trust[k, c] = min(0.999, sum(mass) / len(vs))
        doubt = {}
        for (k, c), t in trust.items():
            for v in graph[k, c]:
                doubt[k, v] = doubt.get((k, v), 1.0) * (1 - t)
        new = {kv for kv, d in doubt.items() if 1 - d >= pii.ACCEPT and kv not in known}
        if not new:
            return {kv for kv, w in known.items() if w < 1}
        known |= dict.fromkeys(new, pii.FOUND_WEIGHT)


def test_added_spans_against_brute_force(spark):
    import random

    rng = random.Random(6)
    seeds, others = [f"+4920555{i:04d}" for i in range(30)], [f"{5550000 + i}" for i in range(60)]
    docs, graph, spans = [], [], {}
    for i in range(500):
        l2, l1, r1 = rng.choice("abcdefgh"), rng.choice("klmnop"), rng.choice("uvwxyz")
        lean = "abcd".find(l2) >= 0
        v = rng.choice(seeds if rng.random() < (0.7 if lean else 0.05) else others[:20] if lean else others)
        text = f"{l2} {l1} {v} {r1}"
        docs.append((i, text))
        spans[i] = (v, f"phone:{text.index(v)}:{text.index(v) + len(v)}")
        graph.append((3, v, (f"< {l2} {l1}", f"= {l1} {r1}"), v.startswith("+")))
    found = {v for _, v in found_by_brute_force(graph)}
    assert 5 < len(found) < 60
    for r in pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        v, span = spans[r.doc_id]
        assert (r.spans == span) == (v.startswith("+") or v in found), (r.doc_id, v)


def test_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
