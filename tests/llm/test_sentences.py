import random

import pytest

from volseg.llm import sentences as S


def pieces(text, lang=None):
    found = S.units(text, lang)
    at = 0
    for a, b in found:
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()
    return [text[a:b] for a, b in found]


CASES = [
    ("en", "It was 3.5 mm long, e.g. in Fig. 3, i.e. short. Then it ended. See No. 7.", ["It was 3.5 mm long, e.g. in Fig. 3, i.e. short.", "Then it ended.", "See No. 7."]),
    ("en", "We met at 5 p.m. on Monday. He left at 6 p.m. Nobody came.", ["We met at 5 p.m. on Monday.", "He left at 6 p.m.", "Nobody came."]),
    ("en", 'It says "Stop. Close it." and waits. Really?! Yes… pH values fell.', ['It says "Stop. Close it." and waits.', "Really?!", "Yes…", "pH values fell."]),
    ("en", 'The log said, "it never moved." The parts (pins, etc.) held. (It is small.) Next one.', ['The log said, "it never moved."', "The parts (pins, etc.) held.", "(It is small.)", "Next one."]),
    ("en", "Title here\n\nBackground\n\n[0001] A hard\nwrapped line. Next\none without end\n\n[0002] Last.", ["Title here", "Background", "[0001] A hard\nwrapped line.", "Next\none without end", "[0002] Last."]),
    ("en", "T\n\nClaims\n\n1. A thing, comprising:\n(a) a part; and\n(b) one. 2. The thing of claim 1. 3. The thing of claim 2.", ["T", "Claims", "1. A thing, comprising:\n(a) a part; and\n(b) one.", "2. The thing of claim 1.", "3. The thing of claim 2."]),
    ("en", "T\nClaims\n1. A thing:\na) a part.\n2. The thing\n ----\nx + 1.\n", ["T", "Claims", "1. A thing:\na) a part.", "2. The thing\n ----\nx + 1."]),
    ("en", "T\n\nClaims\n\n1. A part. 2. The part of claim 1 as in Fig. 3.\n\n3. The part of claim 2 kept at approx. 4.5 mm. 4. Last.", ["T", "Claims", "1. A part.", "2. The part of claim 1 as in Fig. 3.", "3. The part of claim 2 kept at approx. 4.5 mm.", "4. Last."]),
    ("zh", "该值不变。如Fig. 4所示，导轨在此。", ["该值不变。", "如Fig. 4所示，导轨在此。"]),
    ("de", "Am 3. Mai kam Dr. Holm, d. h. spät. Das war z. B. gut. Es gilt ca. 5 Min. Ende.", ["Am 3. Mai kam Dr. Holm, d. h. spät.", "Das war z. B. gut.", "Es gilt ca. 5 Min.", "Ende."]),
    ("en", "This is the state of the Art. The device works. It follows Art. 5 and Pat. App. Pub. No. 7.", ["This is the state of the Art.", "The device works.", "It follows Art. 5 and Pat. App. Pub. No. 7."]),
    ("en", "The parts are labelled a, b and c, i. The other part is d. It is fine.", ["The parts are labelled a, b and c, i.", "The other part is d.", "It is fine."]),
    ("de", "Das ist eine neue Art. Die Vorrichtung arbeitet gut. Es gilt Art. 5 und S. 12, i. d. R. gut.", ["Das ist eine neue Art.", "Die Vorrichtung arbeitet gut.", "Es gilt Art. 5 und S. 12, i. d. R. gut."]),
    ("en", "It lasts (" + "as long as x. y holds, " * 40 + "at least). Then it ends.", ["It lasts (" + "as long as x. y holds, " * 40 + "at least).", "Then it ends."]),
    ("fr", "Attention ! L'écran affiche « Arrêt. Fermer. » puis, c.-à-d. ensuite, cède. Fin.", ["Attention !", "L'écran affiche « Arrêt. Fermer. » puis, c.-à-d. ensuite, cède.", "Fin."]),
    ("es", "¿Qué ocurre? ¡No abrir! El Sr. Ruiz cita la fig. 3 y mide 5 r.p.m. ¿Ya?", ["¿Qué ocurre?", "¡No abrir!", "El Sr. Ruiz cita la fig. 3 y mide 5 r.p.m.", "¿Ya?"]),
    ("ru", "По п. 1, т. е. так и т. д. Стоп. Имеет 1,2 тыс. оборотов.", ["По п. 1, т. е. так и т. д.", "Стоп.", "Имеет 1,2 тыс. оборотов."]),
    ("ja", "表示部は「停止。閉じよ。」と表示する。注意！軸受（例えば、鋼。以下同じ。）は可。", ["表示部は「停止。閉じよ。」と表示する。", "注意！", "軸受（例えば、鋼。以下同じ。）は可。"]),
    ("zh", "他写道：“从未移动。”切勿打开！可以更换……并安装。", ["他写道：“从未移动。”", "切勿打开！", "可以更换……并安装。"]),
    ("ko", '시험 No. 24에서 변하였다. 표시부는 "정지. 닫으시오."라고 알린다. 끝이다.', ["시험 No. 24에서 변하였다.", '표시부는 "정지. 닫으시오."라고 알린다.', "끝이다."]),
    ("th", "การรั่วไหลลดลง 66.69 เปอร์เซ็นต์ อุปกรณ์นี้มีวาล์ว วัสดุที่เหมาะสมได้แก่เหล็ก แก้ว และเซรามิก", ["การรั่วไหลลดลง 66.69 เปอร์เซ็นต์", "อุปกรณ์นี้มีวาล์ว", "วัสดุที่เหมาะสมได้แก่เหล็ก แก้ว และเซรามิก"]),
    ("ar", "كما في ص. 12، تبلغ المسافة. ماذا يحدث؟ لا تفتح!", ["كما في ص. 12، تبلغ المسافة.", "ماذا يحدث؟", "لا تفتح!"]),
    ("hi", "डॉ. ओम्ब्राल आए। क्या होगा? अंतर 3.5 मि.मी. है ।", ["डॉ. ओम्ब्राल आए।", "क्या होगा?", "अंतर 3.5 मि.मी. है ।"]),
]


@pytest.mark.parametrize("lang,text,want", CASES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_cases(lang, text, want):
    assert pieces(text, lang) == want
    assert pieces(text, None) == want or lang == "de"


def test_any_text_is_covered():
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice("abC .!?\n\r\t()[]\"«»„“。！「」…1２.,;ก ก์ 　क।§$\\{") for _ in range(r.randint(0, 80)))
        pieces(text, r.choice([None, "", "en", "de", "xx", "TH ", "ja-x1"]))


def test_long_and_empty():
    assert S.units(None) == [] and S.units("") == [] and S.units(" \n　\t ") == []
    assert len(pieces("A b c. " * 50_000, "en")) == 50_000
    pieces("(" * 50_000, "en")
    pieces('"a ' * 50_000, "en")
    pieces("." * 100_000 + " x", "en")


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en", 5), (2, None, "en", 5), (3, "", None, 5), (4, " Ab ", None, 5)], "doc_id bigint, text string, lang string, start_pos int")
    assert sorted(map(tuple, S.sentence_units(df).collect())) == [(1, 0, 4), (1, 5, 9), (4, 1, 3)]
    assert S.sentence_units(df.limit(0)).collect() == []


def test_language_is_that_of_the_whole_text():
    opening = "The title of the device is given with the words of the applicant. " * 40
    body = "อุปกรณ์ประกอบด้วยตัวเรือนและฝาปิด " * 400
    assert len(opening) > 2000
    assert S.language_of(opening + body, "en") == "th"


def test_paragraphs_have_their_own_language():
    text = "Titel\n\nDie Anlage wird mit einer Abdeckung nach Abb. 3 und Nr. 4 gebaut. Ende.\n\nThe cover is the part of the Nr. The other is with it, i. The end."
    assert pieces(text, "de")[1:] == ["Die Anlage wird mit einer Abdeckung nach Abb. 3 und Nr. 4 gebaut.", "Ende.", "The cover is the part of the Nr.", "The other is with it, i.", "The end."]
