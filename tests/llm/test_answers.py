import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftdocs.llm import answers as A


@pytest.mark.parametrize("a", [None, "", " ", "　", "​", "（）", "…", "**", "<p></p>", "N/A", "nan", "null", "None", "---", "[]", '""', "&nbsp;"])
def test_empty(a):
    assert A.is_empty(a)


@pytest.mark.parametrize("a", ["0", "該当する行は存在しない。", "none of them", "No row matches the condition."])
def test_not_empty(a):
    assert not A.is_empty(a)


@given(st.text("abc", max_size=30), st.text("abc", max_size=30), st.integers(1, 4))
def test_suffix_automaton_covers_common_stretches(q, a, least):
    covered = set()
    for i in range(len(a)):
        for j in range(i + least, len(a) + 1):
            if a[i:j] in q:
                covered.update(range(i, j))
    assert A.SuffixAutomaton(q).uncovered(a, least) == len(a) - len(covered)


def test_copy():
    q = "狭霧物産の運用手順書_000000183.xlsxに記載された倉庫の契約金額（税抜）はいくらですか。"
    assert A.is_copy(q, q) and A.is_copy(q, f"「{q}」") and A.is_copy(q, f"質問：{q}") and A.is_copy(q, q.replace("いくら", "幾ら"))
    assert not A.is_copy(q, q.replace("いくらですか。", "、120,000円")) and not A.is_copy(None, q) and not A.is_copy(q, "円")


@pytest.mark.parametrize("a", ["申し訳ありませんが、お答えできません。", "回答を控えさせていただきます。", "I'm sorry, but I can't help with that.", "As an assistant, I won’t be able to assist with this.", "ノーコメントとさせてください。"])
def test_refusal(a):
    assert A.is_refusal(a)


@pytest.mark.parametrize("a", ["途中解約はできないと定められている。", "お答えする窓口は雁部さんです。", "Requests must be declined in writing by Brasko.", "Pomfray is unable to attend, so the 4th was chosen.", "契約書には違約金に関する記載はない。"])
def test_no_refusal(a):
    assert not A.is_refusal(a)


def test_other_language():
    ja, en = "納期はいつですか。", "When is the batch due?"
    assert A.is_other_language(ja, "The batch is due on the first of May.")
    assert A.is_other_language(en, "納期は五月一日であるとのこと。") and A.is_other_language(ja, "根据新版说明，目标值应为百分之三。") and A.is_other_language(ja, "Le coût est plafonné à 10 yens.")
    assert not A.is_other_language(ja + "英語で答えてください。", "The batch is due on the first of May.")
    assert not A.is_other_language(ja, "gradient boosting") and not A.is_other_language(en, "temp_max") and not A.is_other_language(None, "It is due on the first of May.")


def test_breaks_off():
    assert A.breaks_off("表（三") and A.breaks_off("整備、") and A.breaks_off("the table and") and A.breaks_off("置き換えた。なお、") and A.breaks_off('Note that "')
    assert not A.breaks_off("表（三）") and not A.breaks_off("the table.") and not A.breaks_off("and")


def test_truncated_by_corpus(spark):
    whole = [(i, f"問い{i}は何ですか。", f"担当の{n}さんが書類を確認した。", None) for i, n in enumerate("甲乙丙丁戊己庚辛")]
    d = spark.createDataFrame([*whole, (90, "問いは何ですか。", "担当の壬さんが書類を確", "temp"), (91, None, None, ""), (91, None, None, "")], "id long, q string, a string, defect string")
    got = {(r.id, r.answer_field): r.defect for r in A.defects(d, "id", "q", ["a", "defect"]).collect()}
    assert got[90, "a"] == "truncated" and got[91, "a"] == "empty" and got[91, "defect"] == "empty" and (0, "a") not in got
    assert A.defects(d.limit(0), "id", "q", ["a"]).count() == 0
