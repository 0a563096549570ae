from collections import Counter

from panmixia.llm import quality

SPACES = " \t\n\x0b\x0c\r"


def counts(text):
    text = text or ""
    words = text.encode().split()
    words = [w.decode() for w in words]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(rows, given):
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert found == Counter((i, *counts(t)) for i, t in given)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_counts_match_brute_force(documents, texts):
    check(quality.host_quality(documents).collect(), texts.items())


def test_awkward_rows(awkward):
    check(quality.host_quality(awkward).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_empty(empty):
    assert quality.host_quality(empty).count() == 0


def test_host_of_failing_documents_loses_what_breaks_a_rule(spark):
    good = " ".join(f"word{i}" for i in range(60))
    odd = good + " " + "# " * 30
    rows = [(i, odd, "bad") for i in range(400)] + [(1000 + i, good, f"h{i % 9}") for i in range(900)] + [(5000, odd, "h1"), (5001, good, "bad")]
    found = {r["doc_id"]: r for r in quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[0]["host_rejected"] and not found[0]["kept"]
    assert found[5000]["kept"] and found[5001]["kept"] and found[1000]["kept"]


def test_no_python_on_the_main_path(documents):
    plan = quality.host_quality(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
