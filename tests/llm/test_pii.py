import hashlib
import random
import re
import time

from helixframe.llm.pii import INSTANCE_SCORE, KINDS, PATTERN_SCORE, PATTERN_SEEDS, ROUNDS, base_spans, candidates, context, find_personal, luhn, op2_pii, shape

PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 13 <= len(d) <= 19 and luhn(d) or k == 3 and 9 <= len(d) <= 15
            if ok:
                out.append((k, *m.span()))
    return out


def texts():
    rng = random.Random(6)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1.1", "0001.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (640) 555-0953", "+12", "+1 23", " ", "é🙂", "word ", "\n", "9", ".", "-", "a@b@c.d", "4111111111111111"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]


def test_base_spans_are_those_of_the_patterns():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    for t in [*texts(), None, "", "1" * 15000, "a" * 50000 + "@b.c"]:
        assert base_spans(t) == plain(t), repr(t)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please contact me: user{i}@mail.example now") for i in range(8)]
    rows += [(100, "please contact me: bob77 at home"), (101, "the year 20199 was good"), (102, None), (102, None), (None, "contact me: carol88")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string").repartition(3)
    got = find_personal(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(x.k, x.s, x.e) for x in by[100].spans] == [(0, 19, 24)] and by[100].base == []
    assert [(x.k, x.s, x.e) for x in by[None].spans] == [(0, 12, 19)]
    assert by[101].spans == [] and by[102].spans == []
    assert all([(x.k, x.s, x.e) for x in by[i].base] == plain(rows[i][1]) for i in range(8))
    assert find_personal(df.limit(0)).count() == 0


def test_digest(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[:300])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op2_pii(spark, str(tmp_path)).collect():
        own = plain(rows[r.doc_id][1])
        want = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in own)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in own) for k in range(4)]
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_long_runs_are_read_once():
    began = time.time()
    for part in ("1", "1.", "1.1.1.", "@", "a@", "+1 ", "+1(", "1 ", "1-", "a.", "+"):
        base_spans(part * (2_000_000 // len(part)))
    assert time.time() - began < 60
    for t in ["1" * 3000, "1." * 900 + "x", "9.9.9." * 300, "1.2.3.4.5.6.7.8.9" * 50, "1.2.3.45" + "6" * 300 + ".7.8.9"]:
        assert base_spans(t) == plain(t), t[:20]


def brute_spans(rows):
    """The whole method over dictionaries: base spans and what trusted patterns add, per row."""
    seen = []
    for n, t in enumerate(rows):
        t = t or ""
        own = base_spans(t)
        here = [(k, s, e) for k, s, e in own]
        here += [(-1, s, e) for s, e in candidates(t) if e - s >= 5 and not any(s < y and x < e for _, x, y in own)]
        seen += [(n, k, s, e, t[s:e], context(t, s)) for k, s, e in here if context(t, s)]
    edges = {}
    for _, k, _, _, own, patterns in seen:
        for p in patterns:
            edges[p, own] = max(k, edges.get((p, own), -1))
    base = {own: (k, 1.0) for (_, own), k in edges.items() if k >= 0}
    known, trusted = dict(base), {}
    for _ in range(ROUNDS):
        forms = {(shape(own), known[own][0]) for _, own in edges if own in known}
        trusted = {}
        for p in {p for p, _ in edges}:
            mine = [own for q, own in edges if q == p]
            every = sum(known[o][1] if o in known else 1.0 for o in mine)
            for k in {known[o][0] for o in mine if o in known}:
                hit = sum(known[o][1] for o in mine if o in known and known[o][0] == k)
                alike = sum(o not in known and (shape(o), k) in forms for o in mine)
                if hit >= PATTERN_SEEDS and hit / (every - alike) >= PATTERN_SCORE:
                    trusted[p, k] = hit / (every - alike)
        known = dict(base)
        fresh = {}
        for (p, own), k0 in edges.items():
            if k0 < 0 and own not in base:
                for k in range(4):
                    if (p, k) in trusted:
                        fresh.setdefault((own, k), []).append(min(trusted[p, k], 0.999))
        best = {}
        for (own, k), ps in fresh.items():
            miss = 1.0
            for q in ps:
                miss *= 1 - q
            if 1 - miss >= INSTANCE_SCORE:
                best[own] = max(best.get(own, (-1, 0)), (1 - miss, -k))
        known |= {own: (-k, score) for own, (score, k) in best.items()}
    out = [sorted(base_spans(t)) for t in rows]
    for n, k, s, e, _, patterns in seen:
        got = [(trusted[p, j], -j) for p in patterns for j in range(4) if (p, j) in trusted]
        if k < 0 and got:
            out[n].append((-max(got)[1], s, e))
    return [sorted(x) for x in out]


def test_graph_matches_brute_force(spark):
    rng = random.Random(9)
    card = lambda: "".join(str(rng.randrange(10)) for _ in range(15))
    leads = ["card number: ", "my card is ", "call me at ", "server at ", "write to ", "the year ", "contact me: ", "on page "]
    values = [lambda: f"user{rng.randrange(40)}@mail{rng.randrange(3)}.example", lambda: f"10.{rng.randrange(300)}.0.{rng.randrange(300)}", card, lambda: "4111111111111111", lambda: f"+1 640 555-{rng.randrange(1000, 9999)}", lambda: f"bob{rng.randrange(60)}", lambda: str(rng.randrange(10000, 99999)), lambda: f"12.34.{rng.randrange(400, 900)}.5"]
    likely = {0: [2, 3, 3, 3], 1: [2, 3], 2: [4, 4, 6], 3: [1, 1, 7], 4: [0, 0, 0, 0, 5], 5: [6], 6: [0, 5, 4], 7: [6, 5]}
    rows = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(leads))
            parts.append(leads[k] + values[rng.choice(likely[k])]() + rng.choice([" now", ", then", "\n", " and "]))
        rows.append("so " + " ".join(parts))
    df = spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in find_personal(df).collect()}
    want = brute_spans(rows)
    assert sum(len(w) - len(base_spans(t)) for w, t in zip(want, rows, strict=True)) > 10
    assert [got[n] for n in range(len(rows))] == want
