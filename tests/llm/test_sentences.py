import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import sentences


def cut(text, lines=False):
    return [text[a:b] for a, b in sentences.units(text, lines)]


CASES = [
    ["The job ended at 5 p.m. yesterday.", "See sec. 4.1, e.g. fig. 2.", "Was it full?", "Yes!"],
    ["At 9:11 a.m. Kilorano skipped it.", "It was still running at 5 a.m.", "At 6 it stopped."],
    ["He asked, “Which one?” and left.", "My note read: “Pause first. Then update.”", "Nothing else."],
    ["“Is it full?” the dialog asked.", "(The log shows 5 entries.)", "It hung at 9 %... then it resumed.", "It ended...", "Then nothing."],
    ["The U.S. build differs from the E.U. build.", "Use max. 17 threads.", "I use it on drive D.", "Then retry."],
    ["Große Dateien, z. B. index.bin, bleiben.", "Am 3. Mai um 2:44 Uhr brach er ab.", "Das betrifft Logs usw.", "Ende (s. Abschn. 3.1)!"],
    ["« Est-il plein ? » demande la boîte.", "Voir p. 5, c.-à-d. env. 7 Go.", "Ça marche !", "Il signale les journaux, etc. !", "(Voir fig. 2.)", "btrfs reste."],
    ["¿Seguro?", "¡Claro que sí!", "La versión de EE. UU. no pasa.", "Omitió 5 a las 2:30 p. m. del lunes."],
    ["Пропущены шрифты и т. д.", "В 2024 г. папка выросла, т. е. вдвое.", "«Диск заполнен?» — спросила программа."],
    ["डॉ. Kilo वाला औज़ार।", "कार्य 9 % पर रुका... फिर चल पड़ा।"],
    ["btrfs keeps it raw.", "btrfs keeps it raw.", "shader.cache.so flagged it."],
]


@pytest.mark.parametrize("case", CASES)
def test_spaced_scripts(case):
    assert cut(" ".join(case)) == case
    assert [re.sub(r"\s+", " ", u) for u in cut("\r\n".join(" ".join(case).split(" ")))] == case


@pytest.mark.parametrize("case", [
    ["任务停在9%……后来又继续了。", "窗口显示“空间不足。已取消。”然后就关闭了。", "他写道：“先暂停。再更新。”", "真的吗？！", "容量为３．５倍。"],
    ["「満杯ですか？」と表示された。", "画面に「空きがない。中止。」と出た。", "容量は３．５倍になった．", "やっと動いた！", "残した｡"],
])
def test_wide_scripts(case):
    assert cut("".join(case)) == case


def test_mixed_quotation_marks():
    assert cut('"磁盘满了吗？”程序问。真的吗？') == ['"磁盘满了吗？”程序问。', "真的吗？"]
    assert cut('“Is it full?" the dialog asked. Yes.') == ['“Is it full?" the dialog asked.', "Yes."]
    assert cut('„Ist es voll?“, fragte er. „Nein.” Gut.') == ['„Ist es voll?“, fragte er.', "„Nein.”", "Gut."]


def test_thai_breaks_at_spaces():
    assert cut("ตัวตรวจสอบ ระบบข้าม\nปิดเกม") == ["ตัวตรวจสอบ", "ระบบข้าม", "ปิดเกม"]


def test_blocks():
    text = "# What changed in 3.8?\nFirst line\ngoes on. Second.\n\n3.1 Layout\n\n- Open it. Then start.\n- close it\n1. one\n2. two goes\non\n\nAm\n9. Mai war es. Ende"
    assert cut(text) == ["# What changed in 3.8?", "First line\ngoes on.", "Second.", "3.1 Layout", "- Open it.", "Then start.", "- close it", "1. one", "2. two goes\non", "Am\n9. Mai war es.", "Ende"]


def test_lines():
    assert cut("a. B. c\r\n\n  x \n\t\n", True) == ["a. B. c", "x"]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "\n\n"])
def test_nothing(text):
    assert sentences.units(text) == [] and sentences.units(text, True) == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB1. !?…\"“”()«»。「」…\n\r\t-*#'ไд、，:", max_size=60), st.booleans())
def test_units_cover_all_but_spaces(text, lines):
    spans = sentences.units(text, lines)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in spans)) == re.sub(r"\s", "", text)


def test_very_long_text_is_linear():
    text = "Nothing was rewritten. " * 20_000
    assert len(sentences.units(text)) == 20_000
    assert len(sentences.units("x" * 300_000)) == 1 and len(sentences.units("(" * 20_000)) == 1 and len(sentences.units("." * 50_000)) == 1
    assert len(sentences.units("(" * 20_000 + "]" * 20_000 + '"a" ' * 20_000)) == 1


def test_rows(spark):
    df = spark.createDataFrame([(1, "A. B\nC.", "log", 9), (2, "It ended. Then.", None, 9), (3, None, "note", 9), (4, "", "note", 9), (5, "Ok.", "note", 9), (5, "Ok.", "note", 9)], "doc_id long, text string, kind string, start_at int")
    got = sorted(map(tuple, sentences.sentence_units(df).collect()))
    assert got == [(1, 0, 4), (1, 5, 7), (2, 0, 9), (2, 10, 15), (5, 0, 3), (5, 0, 3)]
    assert sentences.sentence_units(df.where("doc_id > 9")).collect() == []
