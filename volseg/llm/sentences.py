"""Sentence units of documents, in many languages and scripts.

Segmentation rules are tables of pairs: what stands before a position, what stands after it, and whether the text
breaks there. The tables of a language cascade into the common ones; at every position the first pair that matches
decides. A table is compiled into one alternation, so the order of its pairs is the order in which the pattern tries
them. Layout is settled first: paragraphs, headings and claims are found from blank lines, line starts and numbers,
and spans in quotes or brackets are closed to breaks.

Result: ``start_pos, end_pos`` in code points, the end exclusive. Every character that is not white space lies in
exactly one unit, and no unit begins or ends with white space. Null, empty and blank texts have no units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volseg.storage import spread

BREAK, KEEP = True, False

# Abbreviations, headings and sentence openers of each language.
#: Never the end of a sentence.
ABBREVIATIONS = {
    "en": "approx cf e.g i.e viz esp incl vs resp Fig Figs FIG FIGS fig figs Secs Refs Eq Eqs ver Nos p pp Dr Mr Mrs Ms Prof St Messrs Jr ca al",
    "de": "ca bzgl vgl z.B d.h u.a i.d.R Abb Nr bzw evtl ggf inkl max sog Dr Prof Hr Fr Ing Dipl Fig Figs rd",
    "fr": "env cf p ex c.-à-d fig figs tabl n° art chap éd vol réf Fig M MM Mme Mlle Dr Pr av",
    "es": "p ej aprox v fig figs Fig núm pág págs art cap vol Sr Sra Dr Dra Prof ref tab",
    "ru": "т.е т п пп ок рис табл стр см гл ст др им напр проф акад г Fig FIG",
    "ar": "د ص ج أ م",
    "hi": "डॉ श्री क्र मि मि.मी कि से.मी पृ",
    "th": "มม ซม กก พ.ศ ดร นาย",
}
#: Words as well as abbreviations: no end before a number, a name of capitals or a small letter.
NUMBERED = {
    "en": "Tab Tabs Sec Ref Chap Vol Art Pat App Pub Spec Ser Appl",
    "de": "Tab S Abs Art Anm Bd Kap",
}
#: The end of a sentence only if what follows looks like a beginning.
PERHAPS = {
    "en": "in min s h ft hr sec a.m p.m etc Inc Co Corp Ltd LLC ff Cie rpm r.p.m wt mol No no U.S",
    "de": "Min Std usw ff Sek Mio Mrd o u h Str Co",
    "fr": "min etc Cie s suiv",
    "es": "min etc r.p.m seg",
    "ru": "тыс мин град д млн руб сек ч",
}
#: Languages whose texts cite in another one as well, by the tables they share.
ALSO = {"en": ("en",), "de": ("de",), "fr": ("fr", "en"), "es": ("es", "en"), "ru": ("ru", "en")}
#: German words before an ordinal number.
ORDINAL_BEFORE = "am Am der Der die Die das Das dem den des zum vom und im"
CLAIM_HEADS = (
    "claims|what is claimed(?: is)?|we claim|i claim|scope of claims|right-requesting items|patentansprüche|ansprüche|revendications|reivindicaciones|"
    "формула изобретения|权利要求书?|權利要求書|特許請求の範囲|請求の範囲|청구범위|특허청구범위|दावे|عناصر الحماية|ข้อถือสิทธิ"
)
SECTION_HEADS = (
    "abstract(?: of the disclosure)?(?: \\(machine translation\\))?|summary|background(?: technique| art)?|technical field|description|detailed description|zusammenfassung|beschreibung|"
    "stand der technik|technisches gebiet|résumé|abrégé|domaine technique|resumen|descripción|antecedentes|реферат|описание|摘要|要約|技術分野|背景技術|요약|기술분야|배경기술|"
    "सारांश|विवरण|الملخص|الوصف|บทสรุปการประดิษฐ์"
)
#: Thai words that open a clause of the same sentence, and words that open a new one after a number.
THAI_INNER = "และ|หรือ|ซึ่ง|ที่|โดย|ตาม|ถึง|แล้ว|จะ|กับ|ของ|ว่า|ใน|เปอร์เซ็นต์|องศา|นิวตัน|รอบ|บาร์|มม|ซม|กก|มิลลิ|เซนติ|กิโล|ฯลฯ|เท่า|นาที|วินาที|ชั่วโมง|เป็น|คือ"
THAI_OPENERS = "อุปกรณ์|การรั่วไหล|สามารถ|หลัง|ระหว่าง|วัสดุ|เมื่อ|ค่าที่|ดังแสดง|ผู้ใช้"

CLOSERS = "\"”’»“」』)）\\]】〕＞》'"
CJK = "぀-ヿ㐀-鿿ｦ-ﾟ"
THAI = "฀-๿"
#: Letters of the scripts that put spaces between words.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ؀-ۿऀ-ॿ"
FORMULA_VARIABLE = r"(?:[α-ωΑ-Ω∂∑Δ]\w?|R₀|\w_\w|[b-zB-Z](?![\w'’]))"


def _before(words: str) -> list[str]:
    """A fixed-width look-behind for each abbreviation, also as recognition errors leave it (1 for l, c for e)."""
    forms = [f for w in words.split() for f in (w.rstrip("."), w.rstrip(".").replace("l", "1"), w.rstrip(".").replace("e", "c"))]
    return [rf"(?<=(?<![{LETTER}]){re.escape(w)}\.)" for w in dict.fromkeys(forms)]


NUMBER_AFTER = r"\s*(?:[\d§(\[a-zà-ÿ]|[IVXLC]+\b|[A-Z]{1,3}[\s.-]?\d|[A-Z]\b|(?:No|Nos|Nr|App|Appl|Pub|Ser|Pat|Spec)\b)"
FORMAL = r"[\s]*(?:[A-ZÀ-ÖØ-ÞА-ЯЁ¿¡«„“\"]|[a-z][A-Z]|[a-z]-[a-z]|\[\d)"


def _table(lang: str) -> list[tuple[bool, list[str], str]]:
    """The cascade for the full stop: (break?, what stands before, what follows). The language's own tables apply, and
    those of English where technical texts of the language cite in it; those of all if there is no telling."""
    own = ALSO.get(lang, (lang, "en")) if lang else tuple(ABBREVIATIONS)

    def words(lists: dict[str, str]) -> list[str]:
        return list(dict.fromkeys(w for x in own for w in lists.get(x, "").split()))

    hard, soft, numbered = words(ABBREVIATIONS), words(PERHAPS), words(NUMBERED)
    variable = [rf"(?<=·\s.{{{n}}}\s\.)" for n in (1, 2, 3)]
    rules: list[tuple[bool, list[str], str]] = [
        # numbers: decimals torn apart, versions, and the number that a line or a claim begins with
        (KEEP, [r"(?<=\d\.)"], r"\s?\d+\s?[×x]\s?10"),
        (KEEP, [r"(?<=[^\s.]\.)"], r"[^\s\"”’»“」』)）\]】(\[{A-ZÀ-ÖА-ЯЁ" + CJK + r"가-힣" + THAI + r"]"),
        (KEEP, [r"(?<=\n\d\.)", r"(?<=\n\d\d\.)", r"(?<=\A\d\.)", r"(?<=\A\d\d\.)", r"(?<=\.\s\d\.)", r"(?<=\.\s\d\d\.)"], r"\s"),
        # a product of variables whose dot stands alone
        (KEEP, variable, r"\s"),
        (KEEP, [r"(?<=\s\.)"], rf"\s{FORMULA_VARIABLE}\s*(?:[.,;)=+·−-]|$)"),
        # a dot that is followed by further punctuation of the same sentence
        (KEEP, [r"(?<=\.)"], r"\s*[,;:)\]}]"),
        # initials
        (KEEP, [r"(?<=[.!?…] [A-Z]\.)", r"(?<=\n[A-Z]\.)", r"(?<=\A[A-Z]\.)", r"(?<=\b[A-Z]\. [A-Z]\.)", r"(?<=[a-z], [A-Z]\.)", r"(?<=\band [A-Z]\.)"], r"\s*(?:[A-Z]\.|[A-Z][a-z])"),
        (KEEP, [r"(?<=\s[A-Z]\.)"], r"\s[A-Z]\. [A-Z][a-z]"),
        (KEEP, _before("No Nos no nos Nº N°"), r"\s*(?:[\d]|[A-Z]{1,3}[\s.-]?\d)"),
        *([(KEEP, _before(" ".join(numbered)), NUMBER_AFTER)] if numbered else []),
        (KEEP, _before(" ".join(hard)), r"[\s\S]"),
        (BREAK, _before(" ".join(soft)), FORMAL),
        (KEEP, _before(" ".join(w for w in soft if w not in ("no", "No"))), r"\s*(?:[^\W\d_]|\()"),  # a lone No is a word
    ]
    if lang in ("de", ""):
        ordinal = [rf"(?<=\b{w} {d}\.)" for w in ORDINAL_BEFORE.split() for d in (r"\d", r"\d\d")]
        ordinal += [rf"(?<=\b{w}\n{d}\.)" for w in ORDINAL_BEFORE.split() for d in (r"\d", r"\d\d")]
        rules.insert(3, (KEEP, ordinal, r"\s"))
        rules.insert(3, (KEEP, [r"(?<=\bz\. B\.)", r"(?<=\bd\. h\.)", r"(?<=\bu\. a\.)", r"(?<=\bi\. d\.)", r"(?<=\bd\. R\.)"], r"[\s\S]"))
        rules.insert(3, (KEEP, [r"(?<=\b[zdiuo]\.)"], r"\s?(?:[BhadEeRU]|o)\."))
        rules.insert(3, (BREAK, [r"(?<=\b[so]\. o\.)", r"(?<=\bs\. u\.)"], FORMAL))
        rules.insert(3, (KEEP, [r"(?<=\b[so]\.)"], r"\s(?:[ou]\.|[A-Z]\w*\.?\s\d|\d)"))
        rules.insert(3, (KEEP, _before("max"), r"\s?\d"))
    if lang in ("ru", ""):
        rules.insert(3, (KEEP, [r"(?<=т\.\s[едпк]\.)"], r"[\s\S]"))
        rules.insert(3, (BREAK, [r"(?<=т\.\sд\.)", r"(?<=т\.\sп\.)"], FORMAL))
    rules += [
        (BREAK, [r"(?<=\.)"], r"\s"),
        # no space after the dot: only between two words of running text
        (BREAK, [r"(?<=[a-zà-ÿ]{3}\.)", rf"(?<=[{CJK}가-힣]\.)"], rf"(?:[A-Z][a-z]+\s|A\s|[{CJK}가-힣])"),
        (BREAK, [r"(?<=\d\.)"], r"[A-Z][a-z]{2,}\s"),
        (BREAK, [r"(?<=\.)"], r"[\"”’»“」』)\]】]*\s"),
    ]
    return rules


def _compile(rules: list[tuple[bool, list[str], str]]) -> re.Pattern:
    parts = []
    for i, (verdict, before, after) in enumerate(rules):
        parts.append(f"(?P<{'b' if verdict else 'k'}{i}>(?:{'|'.join(before)})(?={after}))")
    return re.compile("|".join(parts))


#: For marks other than a single full stop: (break?, before, after), first match decides.
_MARKS: list[tuple[bool, list[str], str]] = [
    (BREAK, [r"(?<=[.…!?])"], r"\s+(?:[a-z][A-Z]|[a-z]-[a-z])"),
    (KEEP, [r"(?<=…)", r"(?<=\.\.\.)"], rf"\s*(?:[a-zà-ÿа-яё,;:)]|[{CJK}])"),
    (KEEP, [r"(?<=[。！？][」』”’])", r"(?<=[。！？]\))", r"(?<=[。！？]）)"], r"\s*[とっのをにがはで的，。、；：并而且后时]"),
    (KEEP, [r"(?<=[!?؟])"], r"\s*[,;:)]"),
    (KEEP, [r"(?<=[\"”’»“」』])"], r"\s*(?:[a-zà-ÿа-яё—–,;:.)]|ثم|و|ที่|แล้ว|라고|하고|कह)"),
    (KEEP, [r"(?<=[!?][\"”»“])"], r"\s+[a-zà-ÿ]"),
    (BREAK, [r"(?<=[。！？｡])", r"(?<=[。！？｡][」』”’）)】\"])"], r"[\s\S]"),
    (BREAK, [r"(?<=[^\s])"], r"\s"),
    (BREAK, [r"(?<=[!?])"], r"[A-ZÀ-ÖØ-ÞА-ЯЁ¿¡][a-zà-ÿа-яё]"),
    (BREAK, [rf"(?<=[{CJK}ऀ-ॿ।؟])"], r"[\s\S]"),
]
MARKS = _compile(_MARKS)

#: Thai has no full stop; spaces inside a sentence stand at numbers, quotes, lists and clause words.
_THAI_SPACES: list[tuple[bool, list[str], str]] = [
    (KEEP, [r"(?<=\d\])"], r"[ \t]"),
    (KEEP, [r"(?<=ได้แก่)", r"(?<=เช่น)", r"(?<=ข้อความ)"], r"[ \t]"),
    (KEEP, [rf"(?<=[{THAI}\w\"”])"], rf"[ \t]+(?:{THAI_INNER})"),
    (KEEP, [rf"(?<=[{THAI}])"], rf"[ \t]+\S{{1,16}}[ \t]+(?:และ|หรือ)[{THAI}]"),
    (KEEP, [r"(?<=ที่ \d)", r"(?<=ที่ \d\d)", r"(?<=ข้อ \d)", r"(?<=สิทธิ \d)", r"(?<=สิทธิ \d\d)"], rf"[ \t]+[{THAI}]"),
    (BREAK, [r"(?<=[\d\"”)\]₀.?!]|\w)"], rf"[ \t]+(?:{THAI_OPENERS})"),
    (BREAK, [rf"(?<=[{THAI}ฯ])"], rf"[ \t]+[{THAI}]"),
]
THAI_SPACES = _compile(_THAI_SPACES)
THAI_LETTER = re.compile(rf"[{THAI}]")
THAI_CANDIDATE = re.compile(rf"(?<=[{THAI}\w\"”)\]₀])[ \t]+(?=[{THAI}])")

TERMINATOR = re.compile(rf"[.!?…。！？।॥؟｡]+(?:[{CLOSERS}]+|(?<=[.!?…])[   ]»)?")
BRACKET = re.compile(r"[()（）\[\]［］{}「」『』«»„“”\"【】]")
OPENS = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "「": "」", "『": "』", "«": "»", "„": "“”", "“": "”", "【": "】"}
QUOTES = set("「『«„“\"")

BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
PARAGRAPH = re.compile(r"\S(?:(?!\r?\n[^\S\n]*\n)[\s\S])*")
LINE = re.compile(r"\S[^\n]*")
SUB_ITEM = re.compile(r"\(?(?:[a-z]{1,2}|[ivx]{1,5}|\d{1,2})\)\s|[-•–]\s")
RULE_LINE = re.compile(r"-{2,}\s*\Z")
FORMULA_LINE = re.compile(r"(?:(?<![A-Za-zα-ωΑ-Ω])[A-Za-zα-ωΑ-Ω]{1,2}(?![A-Za-zα-ωΑ-Ω])|[^\w\n]|[\d_₀]|max|frac|cdot|[A-Z]\d+[A-Z0-9.]*)+\Z")
WHERE = re.compile(r"where\s")
ENDS = re.compile(rf"[.!?…。！？।؟][{CLOSERS}]*\s*\Z")
CLAIM_LABEL = r"(?:[\[【(]?\s*(?:[Cc][l1]aim|CLAIM|請求項|청구항|权利要求|權利要求|ข้อถือสิทธิที่)\s*(\d{1,3})\s*[\]】)]?[.:：]?|(\d{1,3})\s?(?:\.-|[.．、,)\-:])(?!\d))"
CLAIM_START = re.compile(CLAIM_LABEL)
CLAIM_INSIDE = re.compile(r"(?<=[.。．;；!！।？?؟])\s*(?<!\d[.．])" + CLAIM_LABEL)
CLAIM_HEAD = re.compile(rf"[\[【\s]*(?:\d+\.\s*)?(?:{CLAIM_HEADS})\s*[\]】]?\s*[:：]?\s*\Z", re.I)
SECTION_HEAD = re.compile(rf"[\[【\s]*(?:{SECTION_HEADS})\s*[\]】]?\s*[:：]?\s*\Z", re.I)
#: Blocks of 128 code points of the scripts that settle the language.
SCRIPTS = {"ru": (8, 9), "ar": (12, 13), "hi": (18,), "th": (28,)}
#: Common words, of which the most tell the language.
COMMON = {
    "de": "der die und ist ein eine wird mit nach",
    "fr": "le les est un une des dans selon",
    "es": "el los un una con según del",
    "en": "the of is and with wherein",
}
SPACED = {name: [f" {w} " for w in words.split()] for name, words in COMMON.items()}


@lru_cache(maxsize=32)
def rules_for(lang: str) -> re.Pattern:
    return _compile(_table(lang))


def language_of(text: str, lang: str | None) -> str:
    """The language whose tables apply: by script, else the stated one if its common words bear it out; it may be none."""
    if not text.isascii():
        blocks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) >> 7
        seen = np.bincount(np.minimum(blocks, 63), minlength=64)
        for name, where in SCRIPTS.items():
            if sum(int(seen[b]) for b in where) * 4 > len(text):
                return name
    counts = {name: sum(map(text.count, words)) for name, words in SPACED.items()}
    stated = (lang or "").strip().lower()[:2]
    best = max(counts, key=counts.get)
    if stated in counts and counts[stated] * 2 >= counts[best]:
        return stated
    return best if counts[best] else stated


def _closed_spans(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Matched brackets and quotes as (start, end, opener). Strays, as in damaged formulas, match nothing."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int, str]] = []
    for m in BRACKET.finditer(text, lo, hi):
        ch, at = m.group(), m.start()
        if ch == '"':
            opens = at == lo or text[at - 1].isspace() or text[at - 1] in "(（[「:："
            top = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if top is not None:
                spans.append((stack[top][1], at + 1, '"'))
                del stack[top:]
            elif opens or text[at - 1 : at] not in "0123456789":
                stack.append(('"', at))
            continue
        if ch == "“" and any(k == "„" for k, _ in stack):
            pass
        elif ch in OPENS:
            if not (ch == "(" and text[max(lo, at - 2) : at] == "/ "):
                stack.append((ch, at))
            continue
        for k in range(len(stack) - 1, -1, -1):
            opener, start = stack[k]
            if opener != '"' and ch in OPENS[opener]:
                spans.append((start, at + 1, opener))
                del stack[k:]
                break
            if opener in QUOTES and ch not in "”“»」』":
                break
    return sorted(spans)


def _sentences(text: str, lo: int, hi: int, lang: str, dots: re.Pattern) -> Iterator[int]:
    """Break positions inside one paragraph."""
    spans = _closed_spans(text, lo, hi)
    k, until = 0, lo
    inside: list[tuple[int, int, str]] = []
    thai = lang == "th"
    marks = TERMINATOR.finditer(text, lo, hi)
    points: list[tuple[int, int]] = [(m.start(), m.end()) for m in marks]
    if thai:
        points = sorted(points + [(m.start(), -m.start()) for m in THAI_CANDIDATE.finditer(text, lo, hi)])
    for start, end in points:
        space = end < 0
        end = abs(end)
        if end >= hi:
            break
        if end < until:
            continue
        while k < len(spans) and spans[k][0] <= start:
            inside.append(spans[k])
            k += 1
        if inside:
            inside = [s for s in inside if s[1] > start]
            if space:
                if inside:
                    continue
            else:
                outer = [s for s in inside if s[1] > end]
                if outer:
                    continue
                # the mark stands just before what closes: a bracket ends a sentence only if it began one
                if any(s[2] not in QUOTES and not _opens_sentence(text, lo, s[0]) for s in inside):
                    continue
        if space:
            m = THAI_SPACES.match(text, end, hi)
        elif end - start == 1 and text[start] == ".":
            m = dots.match(text, end, hi)
        else:
            m = MARKS.match(text, end, hi)
        if m and m.lastgroup[0] == "b":
            yield end
            until = end


def _opens_sentence(text: str, lo: int, at: int) -> bool:
    head = text[max(lo, at - 8) : at].rstrip()
    return not head or head[-1] in ".!?…。！？।]" or head.endswith(('"', "”", "»"))


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of paragraphs, by blank lines, or by lines if there are none."""
    if BLANK_LINE.search(text.strip()):
        for m in PARAGRAPH.finditer(text):
            yield m.start(), m.start() + len(m.group().rstrip())
        return
    begin = end = None
    for m in LINE.finditer(text):
        s, e = m.start(), m.start() + len(m.group().rstrip())
        line = text[s:e]
        if begin is not None:
            last_at = text.rfind("\n", begin, end) + 1
            last = text[max(begin, last_at) : end].strip()
            joined = (
                (SUB_ITEM.match(line) and not CLAIM_HEAD.match(last) and not SECTION_HEAD.match(last) and not (line[0].isdigit()))
                or RULE_LINE.match(line)
                or RULE_LINE.match(last)
                or (not ENDS.search(last) and len(last) > 1 and FORMULA_LINE.match(line) and not CLAIM_START.match(line))
                or (WHERE.match(line) and not ENDS.search(last))
            )
            if joined:
                end = e
                continue
            yield begin, end
        begin, end = s, e
    if begin is not None:
        yield begin, end


def _claims(text: str, lo: int, hi: int, expected: int, dots: re.Pattern) -> tuple[list[int], int]:
    """Where further claims begin inside a paragraph of claims, and the next number.

    A number starts a claim if it is the one expected and a sentence may end before it.
    """
    cuts = []
    for m in CLAIM_INSIDE.finditer(text, lo + 1, hi):
        number = int(m.group(1) or m.group(2))
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        if number == expected and at > lo and text[m.start() - 1] == ".":
            verdict = dots.match(text, m.start(), hi)
            if not verdict or verdict.lastgroup[0] == "k":
                continue
        if number == expected and at > lo:
            cuts.append(at)
            expected += 1
    return cuts, expected


def units(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """The units of one text, in order."""
    if not text or not text.strip():
        return []
    whole = language_of(text, lang)
    paragraphs = list(_paragraphs(text))
    by_line = not BLANK_LINE.search(text.strip())
    out: list[tuple[int, int]] = []

    def add(lo: int, hi: int) -> None:
        piece = text[lo:hi]
        lead = len(piece) - len(piece.lstrip())
        lo, hi = lo + lead, lo + len(piece.rstrip())
        if hi > lo:
            out.append((lo, hi))

    claims, expected = False, 1
    for n, (lo, hi) in enumerate(paragraphs):
        body = text[lo:hi]
        # each paragraph has its own tables: an abstract may be in another language than the description
        told = "." in body[:-1] or (whole != "th" and not body.isascii() and THAI_LETTER.search(body))
        language = language_of(body, whole) if told else whole
        dots = rules_for(language)
        if CLAIM_HEAD.match(body):
            claims, expected = True, 1
            add(lo, hi)
            continue
        if claims:
            start = CLAIM_START.match(body)
            if start:
                number = int(start.group(1) or start.group(2))
                cuts, expected = _claims(text, lo, hi, number + 1, dots)
                for a, b in zip([lo, *cuts], [*cuts, hi]):
                    add(a, b)
                continue
            if SECTION_HEAD.match(body):
                claims = False
            elif by_line and out:
                # a line of a claim that began above, perhaps with further claims after it
                cuts, expected = _claims(text, lo, hi, expected, dots)
                out[-1] = (out[-1][0], hi) if not cuts else (out[-1][0], lo + len(text[lo : cuts[0]].rstrip()))
                for a, b in zip(cuts, [*cuts[1:], hi]):
                    add(a, b)
                continue
        if n == 0 and len(paragraphs) > 1 and not ENDS.search(body):
            add(lo, hi)
            continue
        at = lo
        for cut in _sentences(text, lo, hi, language, dots):
            add(at, cut)
            at = cut
        add(at, hi)
    return out


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        ids, starts, ends = [], [], []
        for key, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
            found = units(text, lang)
            ids.extend([key] * len(found))
            starts.extend(a for a, _ in found)
            ends.extend(b for _, b in found)
        yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "start_pos": pd.Series(starts, dtype="int32"), "end_pos": pd.Series(ends, dtype="int32")})


def sentence_units(documents: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos`` for every unit of every text; further columns are ignored.

    ``doc_id`` must not be null; texts that are null, empty or blank have no rows. Each text is read whole, where it lies unless the table has
    fewer partitions than there are cores.
    """
    rows = spread(documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull()))
    return rows.mapInPandas(_batches, "doc_id bigint, start_pos int, end_pos int")
