import hashlib
import re

from panmixia.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    products = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in products) % 10 == 0


def fine(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if fine(k, m[0])] for k, p in PATTERNS.items()}


def check(rows, given):
    for r in rows:
        base = brute(given[r["doc_id"]])
        spans = ",".join(f"{k}:{a}:{b}" for k, v in base.items() for a, b in v)
        assert [r[f"n_{k}"] for k in base] == [len(v) for v in base.values()]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), given[r["doc_id"]]
        assert r["spans"].startswith(spans)


def test_base_matches_brute_force(documents, texts):
    check(pii.detect(documents).collect(), texts)


def test_hard_texts(spark):
    given = dict(enumerate([
        "a@b.c@d.e x.y_z@q-r.co.uk._w@e.f", "@a.b a@.b a@b a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3.99999999999999",
        "4111 1111 1111 1111 4111-1111-1111-1112 4 1 1 1", "+1 (653) 555-0828 +49.30.1234567- +1 2", "é漢 +44 20 7946 0958 é me@x.org 漢",
        "1234567890123456789012345678901234567890", "", None, "x" * 5000 + "@" + "y" * 5000 + ".com", "1 " * 3000, "12.34.56.78\n" * 700,
        "0000000000000000 5105105105105100", "user(at)host.org call 555-123-4567 in 2024-01-02",
    ]))
    rows = pii.detect(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(given)
    check(rows, given)


def test_awkward(awkward, empty):
    assert pii.detect(awkward).count() == awkward.count()
    assert pii.detect(empty).count() == 0


def test_trees_learn_an_interaction():
    counts = {0: (90.0, 10.0), 1: (10.0, 90.0), 2: (10.0, 90.0), 3: (90.0, 10.0)}
    model = pii.boost(counts)
    assert [model.margin(p) > 0 for p in range(4)] == [False, True, True, False]
    assert pii.calibrate(model, counts, 0.85) == min(model.margin(1), model.margin(2))
    assert pii.boost({}).trees == []


def test_loose_candidates_are_added(spark):
    near = [(i, f"please call {200 + i % 700}-555-{1000 + i} or phone +1 {200 + i % 700}-555-{1000 + i}", ) for i in range(200)]
    far = [(1000 + i, f"version {i % 90 + 10}.{i % 70 + 10} of page {i % 60 + 10}-{i % 50 + 10}") for i in range(200)]
    rows = pii.detect(spark.createDataFrame(near + far, "doc_id long, text string")).collect()
    added = {r["doc_id"]: r["n_added"] for r in rows}
    assert sum(added[i] for i in range(200)) > 100 and sum(added[1000 + i] for i in range(200)) == 0


def account(i):
    """A bank account number with its check digits."""
    rest = f"{i * 7919 % 10**18:018d}"
    check = 98 - int(rest + "131400") % 97
    return f"DE{check:02d} " + " ".join(rest[k : k + 4] for k in range(0, 18, 4))


def test_mail_forms_and_accounts_are_added(spark):
    """Neither kind has any base span of its own form to learn from."""
    ends = ("com", "org", "de")
    given = {i: f"write to user{i}@host{i % 40}.{ends[i % 3]} soon" for i in range(300)}
    given |= {1000 + i: f"write to friend{i} (at) place{i % 30}.{ends[i % 3]} soon, or see him {'xyz'[i % 3]}{i} at the.corner of it" for i in range(100)}
    given |= {2000 + i: f"pay to {account(i)} now" for i in range(100)}
    given |= {3000 + i: f"part AB{i % 90 + 10} {1000 + i} {2000 + i} {3000 + i} {4000 + i} in stock" for i in range(100)}
    rows = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()}
    added = {i: [given[i][int(a) : int(z)] for k, a, z in (x.split(":") for x in r["spans"].split(",") if x) if k in ("mail", "iban")] for i, r in rows.items()}
    assert sum(len(added[1000 + i]) == 1 and added[1000 + i][0].startswith(f"friend{i} (at)") for i in range(100)) > 95
    assert sum(added[2000 + i] == [account(i)] for i in range(100)) > 95
    assert sum(len(added[3000 + i]) for i in range(100)) < 5


def test_no_python_on_the_main_path(documents):
    plan = pii.detect(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
