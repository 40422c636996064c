"""Sentence units of texts in all scripts.

Candidates are runs of terminators as the Unicode property Sentence_Break knows them (STerm, ATerm, and dots of omission).
A candidate ends a unit unless something holds the sentence open: a quotation or bracket that is not closed yet, an
abbreviation of the languages below, an ordinal, a lower-case word behind it, or, for omission dots, anything but
the begin of a new sentence. Scripts that write no terminators (Thai, Lao) break at spaces. Blank lines, headings and list
entries bound the blocks in which this happens; in logs and manifests each line is a unit.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import busy

# Abbreviations after which a sentence goes on, by language, without their last dot and in lower case.
# A space stands in those of several words.
GOES_ON = {
    "en": "e.g i.e e. g i. e cf no nos vs fig figs sec secs ch vol approx ver v p pp ed eds al ca max dept est mr mrs ms dr prof st rev gen sen rep viz resp op incl excl",
    "de": "z. b z.b d. h d.h u. a u.a o. ä o.ä i. d. r s. o s. u v. a nr nrn abschn abb tab lt ca bzw evtl ggf inkl exkl max min mind vgl s sog bspw gem zzgl abzgl st hr fr dr prof kap ebd art abs",
    "fr": "p. ex p.ex c.-à-d c. -à-d env cf p pp fig art chap vol n mm mme mlle m dr st ste éd réf tél max min",
    "es": "p. ej p.ej ee ee. uu ee.uu núm núms pág págs aprox sr sra srta dr dra ud uds fig art cap vol máx mín",
    "ru": "т. е т.е т. к т.к т. н напр см ср стр рис табл ок тыс млн млрд гл им св ст пп разд",
    "hi": "डॉ श्री प्रो सं रु",
    "it": "p. es pag pagg dott",
    "pt": "p. ex pág nº exmo",
}
# Those of them that are words too; a capital behind them begins a sentence.
ALSO_WORDS = frozenset("no art mind gem op tab max min sec gen rep inkl".split())
# Those that may also end a sentence; a capital behind them decides.
MAY_END = {
    "all": "etc a.m p.m a. m p. m min hr hrs inc ltd co corp jr sr usw u. s. w usf std tsd т. д т.д т. п т.п г гг руб коп кг мин сек esq bros",
}
# Words behind which an ordinal stands in German, and months behind one.
BEFORE_ORDINAL = frozenset("am dem den der des die das vom zum zur beim im ab bis seit".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
NEVER = frozenset(" ".join(x.split()) for words in GOES_ON.values() for x in regex.findall(r"(?:\S+\. )*\S+?(?= |$)", words))
ENDING = frozenset(x for words in MAY_END.values() for x in regex.findall(r"(?:\S+\. )*\S+?(?= |$)", words))
#: Adverbials of time that open a sentence, up to an abbreviation.
OPENING_TIME = regex.compile(r"(?i)(?:(?:at|around|by|until|since|from|before|after|on|about|a las|hacia las|sobre las)\s+\S+|(?:в|к|с|до)\s+\d+)\s*$")

LINE = regex.compile(r"[^\r\n\x85\u2028\u2029]*(?:\r\n|[\r\n\x85\u2028\u2029]|$)")
HEADING = regex.compile(r"[ \t]*#{1,6}[ \t]+\S")
BULLET = regex.compile(r"[ \t]*[-*+•‣◦·▪●–][ \t]+(?=\S)")
NUMBERED = regex.compile(r"[ \t]*(\d{1,3})[.)][ \t]+(?=\S)")
STOP = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…‥]+|(?<=[\p{Thai}\p{Lao}])\s+(?=[\p{Thai}\p{Lao}\p{Lu}\p{Lo}])")
SPACE = regex.compile(r"\s*")
BEFORE = regex.compile(r"\S+\Z")
NAME_LIKE = regex.compile(r"[\w-]+(?:[._](?!\p{Lu}\p{Ll})[\w-]+)+")
CASELESS = regex.compile(r"[\p{Lo}\p{M}]")
WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
RUN = regex.compile(r"\w+")
LETTERS = regex.compile(r"\p{L}+")
DOTTED = regex.compile(r"\p{L}(?:\.\p{L})+")
FULL_STOP = regex.compile(r"[\p{SB=STerm}--[!?]]|[｡．]", regex.V1)
LOUD = regex.compile(r"[!?]")
IDEOGRAPHS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
DEVANAGARI = regex.compile(r"\p{Devanagari}")
CAPITALIZED = regex.compile(r"\p{Lu}\p{Ll}+(?=[\s,.'’!?:]|$)")
#: Brackets of all scripts: each opening one with the closing one that follows it in Unicode.
BRACKETS = {chr(c): chr(e) for c in range(0x28, 0xFFFF) if unicodedata.category(chr(c)) == "Ps" and chr(c) not in "‚„" for e in (c + 1, c + 2) if unicodedata.category(chr(e)) == "Pe" and (e == c + 1 or unicodedata.category(chr(c + 1)) != "Pe")}
# Quotation marks and what closes them.
CLOSES = BRACKETS | {"«": "»", "“": "”", "„": "“", "‚": "‘", '"': '"'}
MIXED_CLOSE = {"”": ("“", '"'), '"': ("”",)}
QUOTES = frozenset("「『«“„‚\"")
ENDS = frozenset(CLOSES.values()) | {"’", "”"}
MARK = regex.compile("[" + "".join(regex.escape(c) for c in sorted({*CLOSES, *CLOSES.values(), "”"})) + "]")
#: What goes on with a sentence: marks of that property but dashes, and marks that end or close.
GOES_ON_WITH = regex.compile(r"[\p{SB=SContinue}…！？!?)\]）」』--[\-–—]]", regex.V1)
#: A name that stays in lower case: letters with digits behind them, or a word without a vowel.
LOWER_NAME = regex.compile(r"(?=[a-z0-9]*[0-9])[a-z][a-z0-9]+|[b-df-hj-np-tv-xz]{3,}")
LINE_KINDS = ("log", "manifest")


def _pairs(text: str) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets (first, last index), in order. What is never closed opens nothing."""
    stack: list[tuple[str, int]] = []
    awaited: Counter[str] = Counter()  # closing marks that something open waits for, so that stray ones cost nothing
    found: list[tuple[int, int]] = []
    for m in MARK.finditer(text):
        mark, at = m.group(), m.start()
        # where straight and curly marks are mixed, one closes the other
        wanted = mark if awaited[mark] else next((w for w in MIXED_CLOSE.get(mark, ()) if awaited[w]), None)
        if wanted:
            while True:
                opener, began = stack.pop()
                awaited[CLOSES[opener]] -= 1
                if CLOSES[opener] == wanted:
                    break
            found.append((began, at))
        elif mark in CLOSES:
            behind = text[at + 1 : at + 2]
            if mark == '"' and (not behind or behind.isspace()):
                continue
            stack.append((mark, at))
            awaited[CLOSES[mark]] += 1
    found.sort()
    outer: list[tuple[int, int]] = []
    for pair in found:
        if not outer or pair[0] > outer[-1][1]:
            outer.append(pair)
    return outer


def _capital(text: str, at: int) -> bool:
    """Whether a sentence may begin here: no lower-case letter, also behind marks that open."""
    while at < len(text) and (text[at] in CLOSES or text[at] in "¿¡*_"):
        at += 1
    return at < len(text) and not text[at].islower() and text[at] not in ",;:)%/&+=—–-"


def _begins(text: str, at: int) -> bool:
    """The same, or a name in lower case: of a file or a known product."""
    run = RUN.match(text, at)
    return _capital(text, at) or NAME_LIKE.match(text, at) is not None or (run is not None and LOWER_NAME.fullmatch(run.group()) is not None)


def _word_before(text: str, start: int, at: int) -> tuple[str, str]:
    """The run of non-spaces before `at` and the word before that."""
    m = BEFORE.search(text, max(start, at - 80), at)
    if not m:
        return "", ""
    token = m.group().lstrip("([{（«“„\"'‘「¿¡*_—–")
    left = text[max(start, m.start() - 80) : m.start()].rstrip()
    m = BEFORE.search(left)
    return token, m.group().lstrip("([{（«“„\"'‘「¿¡") if m else ""


def _dot_ends(text: str, start: int, at: int, behind: int) -> bool:
    """Whether the single dot at `at`, with white space up to `behind`, ends the sentence from `start`."""
    token, before = _word_before(text, start, at)
    low, joined = token.lower(), f"{before} {token}".lower()
    next_word = NAME_LIKE.match(text, behind)
    lower_start = text[behind].islower() and ((next_word and not next_word.group().endswith((".", "_"))) or LOWER_NAME.fullmatch(RUN.match(text, behind).group()) is not None)
    if joined in NEVER or low in NEVER:
        return low in ALSO_WORDS and joined not in NEVER and text[behind].isupper()
    if DOTTED.fullmatch(token) and low not in ENDING:
        return False
    if joined in ENDING or low in ENDING:
        size = len(joined) if joined in ENDING else len(low)
        return _capital(text, behind) and not OPENING_TIME.fullmatch(text[start : at - size].strip())
    if len(token) == 1 and token.isalpha():
        if token.islower() or not _capital(text, behind):
            return False
        return bool(before) and before[-1:].isalpha() and before.islower()
    if token.isdigit() and len(token) <= 3:
        word = LETTERS.match(text, behind, behind + 20)
        if word and (before.lower() in BEFORE_ORDINAL or word.group().lower() in MONTHS):
            return False
    # a long plain word is no abbreviation, so a lower-case sentence may follow
    plain = len(token) >= 5 and token.isalpha() or token[-1:] in (")", "%")
    return lower_start or plain or _capital(text, behind)


def _ends(text: str, start: int, begin: int, end: int, close: int, pair: tuple[int, int] | None) -> bool:
    """Whether the stop text[begin:end], closed by marks up to `close`, ends the sentence that began at `start`.

    pair: the outermost quotation or bracket that those marks close.
    """
    stop = text[begin:end]
    behind = SPACE.match(text, close).end()
    if behind >= len(text):
        return False
    gap, new = behind > close, text[behind]
    wide = FULL_STOP.search(stop) is not None
    omission = not wide and not LOUD.search(stop) and ("…" in stop or "‥" in stop or len(stop) > 1)
    if GOES_ON_WITH.match(new) or (new in "—–-" and gap and not text[behind + 1 : behind + 2].isalnum()):
        return False
    if pair:
        opener = text[pair[0]]
        at_start = not text[start : pair[0]].strip()
        if opener not in QUOTES:
            return at_start and (gap or wide) and _begins(text, behind)
        led = text[start : pair[0]].rstrip()[-1:] in (":", "：")
        if CASELESS.match(new) or WIDE.match(new):
            return led or (at_start and gap and not wide)
        if new in QUOTES and at_start:
            return True
        return gap and (_begins(text, behind) if led else _capital(text, behind))
    if wide:
        return not (stop == "．" and text[begin - 1 : begin].isdigit() and new.isdigit() and not gap)
    last = text[begin - 1 : begin]
    if omission:
        if CASELESS.match(last) and CASELESS.match(new):
            return False
        if WIDE.match(new) and IDEOGRAPHS.search(text, max(start, begin - 12), begin):
            return False
        if DEVANAGARI.search(text, max(start, begin - 12), begin) and DEVANAGARI.match(new):
            return False
        if not gap:
            return new.isupper() and last.islower() and len(text) > behind + 1 and text[behind + 1].islower()
        return _begins(text, behind)
    if not gap:
        if CASELESS.match(new) and stop != ".":
            return True
        if not (new.isupper() and CAPITALIZED.match(text, behind)) and not (new in "«“„¿¡" and stop != "."):
            return False
        return last.islower() or last in ")%”»" or last.isdigit() or (last.isupper() and stop != ".")
    if stop == ".":
        return _dot_ends(text, start, begin, behind)
    return True


def _split(text: str, first: int) -> list[tuple[int, int]]:
    """Units of one block; before `first` (behind a list marker) nothing ends."""
    pairs = _pairs(text)
    starts = [a for a, _ in pairs]
    opening = set(starts)
    units, start = [], SPACE.match(text).end()
    sentence = max(start, first)
    for m in STOP.finditer(text):
        begin, end = m.span()
        if begin < max(sentence, first):
            continue
        k = bisect_right(starts, begin) - 1
        inside = pairs[k] if k >= 0 and pairs[k][0] <= begin < pairs[k][1] else None
        if m.group()[0].isspace():
            if inside is None:
                units.append((start, begin))
                start = sentence = end
            continue
        close, pair = end, None
        while close < len(text):
            at = close
            if text[at].isspace() and inside and text[inside[1]] == "»" and not text[at : inside[1]].strip():
                at = inside[1]
            if text[at] not in ENDS and not (inside and at == inside[1]):
                break
            if inside and at == inside[1]:
                pair, inside = inside, None
            elif text[at] in CLOSES and text[at] != '"' and at in opening:
                break
            elif text[at] == '"' and at in opening:
                break
            close = at + 1
        if inside is not None:
            continue
        if _ends(text, sentence, begin, end, close, pair):
            units.append((start, close))
            start = sentence = SPACE.match(text, close).end()
    if start < len(text) and text[start:].strip():
        units.append((start, len(text.rstrip())))
    return units


def _blocks(text: str):
    """(start, end, length of the list marker) of each heading, list entry and paragraph."""
    open_from, open_to, marker, listed = None, 0, 0, None
    for m in LINE.finditer(text):
        line = m.group()
        if not line:
            continue
        if not line.strip():
            if open_from is not None:
                yield open_from, open_to, marker
            open_from, listed = None, None
            continue
        bullet, number = BULLET.match(line), NUMBERED.match(line)
        if number and open_from is not None and listed != int(number.group(1)) - 1 and not (marker and number.group(1) == "1"):
            number = None  # a wrapped line that happens to begin with a number
        if HEADING.match(line):
            if open_from is not None:
                yield open_from, open_to, marker
            yield m.start(), m.end(), 0
            open_from, listed = None, None
        elif bullet or number:
            if open_from is not None:
                yield open_from, open_to, marker
            open_from, marker = m.start(), (bullet or number).end()
            listed = int(number.group(1)) if number else None
        elif open_from is None:
            open_from, marker = m.start(), 0
        open_to = m.end()
    if open_from is not None:
        yield open_from, open_to, marker


def units(text: str | None, lines: bool = False) -> list[tuple[int, int]]:
    """Offsets (first, behind the last) in code points of a text's units. lines: each line that isn't blank is one.

    None, empty and blank texts have none. All but white space lies in exactly one unit.
    """
    if not text:
        return []
    found: list[tuple[int, int]] = []
    if lines:
        for m in LINE.finditer(text):
            if line := m.group().strip():
                start = m.start() + m.group().index(line)
                found.append((start, start + len(line)))
        return found
    for start, end, marker in _blocks(text):
        block = text[start:end]
        if HEADING.match(block):
            inner = block.strip()
            at = start + block.index(inner)
            found.append((at, at + len(inner)))
        else:
            found += [(start + a, start + b) for a, b in _split(block, marker)]
    return found


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", kind: str | None = "kind", line_kinds: tuple[str, ...] = LINE_KINDS) -> DataFrame:
    """(key, start_at, end_at) of every unit of every text; texts without any give no rows.

    A null kind counts as prose. Other columns of df play no part. A text is handled whole in one task, in linear time.
    """

    @F.arrow_udf("array<struct<start_at:bigint,end_at:bigint>>")
    def find(texts: pa.Array, lined: pa.Array) -> pa.Array:
        offsets, starts, ends = [0], [], []
        for one, by_line in zip(texts.to_pylist(), lined.to_pylist()):
            for a, b in units(one, by_line):
                starts.append(a)
                ends.append(b)
            offsets.append(len(starts))
        pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start_at", "end_at"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    lined = F.coalesce(F.col(kind).isin(*line_kinds), F.lit(False)) if kind else F.lit(False)
    return busy(df).select(key, F.explode(find(F.col(text), lined)).alias("unit")).select(key, "unit.start_at", "unit.end_at")
