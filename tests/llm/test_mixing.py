import pytest

from tablecraft.llm import mixing
from tests.llm.conftest import prose
from tests.llm.test_bytehash import split


def fill(sizes, weights, percent=150, most=2):
    """Shares by sharing again and again what is above a cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()) * percent / 100, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        heavy = sum(weight[s] for s in names if s not in capped)
        share = {s: most * sizes[s] if s in capped else weight[s] * left / heavy for s in names}
        above = {s for s in names if s not in capped and share[s] >= most * sizes[s]}
        if not above:
            return share
        capped |= above


@pytest.fixture
def documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, prose(1 + i * 37 % 90, i), ("a", "é", "Z", "b", None, "\U0001f600", "￿")[min(i % 11, 6)]) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_budgets_are_met_exactly(documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == 300
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    share = fill(sizes, mixing.WEIGHTS)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(share[r["source"]], abs=1e-6)
    assert taken == {s: round(share[s]) for s in sizes}
    # Documents of a source are cut in one order: at most one of each is taken in part.
    part = [r["source"] for r in rows if r["taken"] % max(r["size"], 1)]
    assert len(part) == len(set(part))
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_the_mix_as_rows(documents):
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(documents).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {}
    for r in mixing.mixed(documents).collect():
        assert texts[r["doc_id"]].startswith(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(split(r["text"]))
    assert got == {d: t for d, t in plan.items() if t}


def test_odd_rows(spark, odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == 20
    sizes = {}
    for r in odd_documents.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(split(r["text"]))
    share = fill(sizes, mixing.WEIGHTS)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert taken == {s: round(share[s]) for s in sizes}
    out = mixing.mixed(odd_documents)
    assert out.columns == odd_documents.columns
    assert sum(len(split(r["text"])) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed(no_documents).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")).count() == 2
