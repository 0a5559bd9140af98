import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftdocs.llm import pack, split


def brute(text, limit, overlap, least):
    """The rule, read literally."""
    start, out, n = 0, [], len(text)
    while n - start > limit:
        ends = range(start + least, start + limit + 1)
        kinds = (
            [e for e in ends if text[e - 1] == "\n"],
            [e for e in ends if text[e - 1] in "。！？" or (text[e - 1] in ".!?" and text[e : e + 1] == " ")],
            [e for e in ends if text[e - 1] in " 　"],
            [start + limit],
        )
        end = max(next(k for k in kinds if k))
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


texts = st.text(alphabet="ab .!?\n。　é", min_size=0, max_size=300)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_ordered_plan_is_the_rule(text):
    assert split.best_plan(text, 40, 8, 21, "ordered") == brute(text, 40, 8, 21)


@settings(max_examples=100, deadline=None)
@given(texts)
def test_total_plan_covers_and_is_no_worse(text):
    limit, overlap, least = 40, 8, 21
    plan = split.best_plan(text, limit, overlap, least, "total")
    assert plan[0][0] == 0 and plan[-1][1] == len(text)
    for (_, e), (s, _) in zip(plan, plan[1:], strict=False):
        assert s == e - overlap
    assert all(e - s <= limit for s, e in plan) and all(e - s >= least for s, e in plan[:-1])

    def penalty(e):
        last, after = text[e - 1], text[e : e + 1]
        return 0 if last == "\n" else 1 if last in "。！？" or (last in ".!?" and after == " ") else 2 if last in " 　" else 3

    def cost(p):
        return sum(penalty(e) + ((limit - e + s) / limit) ** 2 for s, e in p[:-1]) + ((limit - p[-1][1] + p[-1][0]) / limit) ** 2

    assert cost(plan) <= cost(brute(text, limit, overlap, least)) + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=90))
def test_total_plan_is_the_best_of_all(text):
    limit, overlap, least, n = 20, 4, 11, len(text)

    def kind(e):
        return 0 if text[e - 1] == "\n" else 1 if text[e - 1] == "." and text[e : e + 1] == " " else 2 if text[e - 1] == " " else 3

    def least_cost(s):
        if n - s <= limit:
            return ((limit - n + s) / limit) ** 2
        ends = [e for e in range(s + least, s + limit + 1) if kind(e) < 3] or [s + limit]
        return min(kind(e) + ((s + limit - e) / limit) ** 2 + least_cost(e - overlap) for e in ends)

    plan = split.best_plan(text, limit, overlap, least, "total")
    got = sum(kind(e) + ((limit - e + s) / limit) ** 2 for s, e in plan[:-1]) + ((limit - plan[-1][1] + plan[-1][0]) / limit) ** 2
    assert abs(got - least_cost(0)) < 1e-9


def test_split_edges(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 1200, "x"), (4, "b" * 1201, "x"), (4, "b" * 1201, "x"), (5, "c " * 20000, "x")], "id long, text string, piece_no string")
    rows = split.split_oversized(d, ["id"]).collect()
    assert {r.id for r in rows} == {4, 5}
    assert sorted((r.piece_no, r.start_pos, r.end_pos) for r in rows if r.id == 4) == [(1, 0, 1200), (1, 0, 1200), (2, 1020, 1201), (2, 1020, 1201)]
    assert max(r.end_pos for r in rows if r.id == 5) == 40000
    assert split.split_oversized(d.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(d, ["id"], limit=100, overlap=100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_bins_never_overflow(sizes, room):
    bins, used = pack.Bins(50, room), {}
    for s in sizes:
        number, at = bins.put(s)
        assert at == used.get(number, 0)
        used[number] = at + s
        assert used[number] <= 50 and bins.count <= room
    for free, stack in bins.by_free.items():
        assert bins.mask >> free & 1 and all(50 - used[n] == free for n in stack)


def test_pack_edges(spark):
    d = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 2048), (5, 2049), (6, 5000), (7, 10), (7, 10)], "doc_id long, n long").coalesce(1)
    rows = pack.pack(d.withColumn("tokens", d.n), "doc_id", "n").collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.part_no, r.parts, r.start, r.tokens))
    assert set(parts) == {4, 5, 6, 7}
    assert parts[4] == [(1, 1, 0, 2048)] and sorted(parts[6]) == [(1, 3, 0, 2048), (2, 3, 2048, 2048), (3, 3, 4096, 904)] and len(parts[7]) == 2
    filled = {}
    for r in rows:
        filled[r.container_id] = filled.get(r.container_id, 0) + r.tokens
    assert max(filled.values()) <= 2048
    assert pack.pack(d.limit(0), "doc_id", "n").count() == 0


def test_tokens_by_rule_and_by_file(spark):
    d = spark.createDataFrame([("ab_1 c、d\r\n\t",), ("",), (None,)], "t string")
    assert [r.n for r in d.select(pack.rule_tokens("t").alias("n")).collect()] == [4, 0, None]
    from pathlib import Path

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if Path(path).exists():
        got = [r.n for r in d.select(pack.file_tokens(path)("t").alias("n")).collect()]
        assert got[0] > 0 and got[1] == 0 and got[2] is None
