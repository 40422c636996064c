"""The same installed game in two lists that share no id.

Probabilistic record linkage. Names and folders are read into a work (words of the title), a number in a series, a kind
(demo, soundtrack, server) and an edition; tags that make no other game are dropped. Several blocking passes bring together records
that share an exact work, its words in any order, a rare word up to one edit, the set of its common words up to one word and
one edit in each, or an acronym with a first word. Pairs of distinct forms are compared in five fields: name, folder, number,
kind and edition. Expectation-maximisation over the counts of the levels estimates how likely each is among matches and among
others; the posterior is the confidence and alone decides.

Every step works on distinct forms, so that copies meet once; they are expanded at the end. Only the counts of the level
patterns (some hundreds) and the words common in works (each in one of 2,000 or more, hence at most some
thousands) come to the driver.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.skew import fragment_replicate_join
from stowage.session import checkpointed, tasks_of

def deletions(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


@dataclass(frozen=True)
class Vocabulary:
    """Words with a meaning of their own in names; other lists of other trades can be given."""

    #: Say nothing about which game it is.
    editions: frozenset[str] = frozenset("edition definitive complete goty deluxe ultimate enhanced remastered anniversary collectors premium standard legendary".split())
    tags: frozenset[str] = frozenset("gog steam egs uplay itch windows linux macos win32 win64 x64 x86 amd64 copy kopie backup".split())
    #: Make another game of the same title.
    kinds: tuple[tuple[str, str], ...] = (("demo", "demo"), ("soundtrack", "soundtrack"), ("ost", "soundtrack"), ("dedicated", "server"), ("server", "server"), ("beta", "beta"), ("prologue", "prologue"), ("playtest", "beta"), ("expansion", "dlc"), ("dlc", "dlc"), ("sdk", "tools"))
    kind_of: dict = field(init=False, compare=False)
    #: What is left of a word typed with care enough to be read with one error, without a letter: the words.
    near: dict = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "kind_of", dict(self.kinds))
        near: dict[str, list[str]] = {}
        for w in (*sorted(self.editions), *self.kind_of, "windows"):
            if len(w) >= 4:
                for form in deletions(w):
                    near.setdefault(form, []).append(w)
        object.__setattr__(self, "near", near)

    def misspelled(self, word: str) -> str | None:
        """The word of the lists that a word is with one error."""
        if len(word) < 3 or len(word) > 14:
            return None
        return next((t for form in deletions(word) for t in self.near.get(form, ()) if distance(word, t, 1) <= 1), None)


STOP = frozenset("the of and a an".split())
ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13}

CODE = regex.compile(r"([a-z]+)(\d?)[-_ ]?0[0-9a-z]{5}")
BRACKETED = regex.compile(r"[(\[]([^)\]]*)[)\]]")
VERSION = regex.compile(r"\bv\d+(?:[. ]\d+)*\b")
GLUED_VERSION = regex.compile(r"(?<=\p{L}|\d)[vV]\d+\.\d+(?:\.\d+)*$")
WORD = regex.compile(r"[^\W_]+")
MARKS = regex.compile(r"[\p{Mn}\p{Cf}'’`´]")
SLASH = regex.compile(r"[/\\]")
FRAME = regex.compile(r"^[\s\"“”']+|[\s\"“”'.]+$")
PARTED = regex.compile(r"[\s_-]")
INITIALS = regex.compile(r"(\p{Lu}\p{L}{0,5}?\p{Lu}|\p{Lu}\p{L}{0,4}\p{Lu}\p{L}?|\p{Lu}{2,7})(\d{0,2})")
CAMEL = regex.compile(r"(?<=[\p{Ll}])(?=\p{Lu})|(?<=\p{L})(?=\p{N})")
#: A word is common if it stands in this share of works, and in so many at least.
COMMON, COMMON_LEAST = 1 / 2000, 4
FORM = "struct<core:string,number:int,kind:string,edition:string,acronym:string,code:string,cut:boolean>"


@lru_cache(200_000)
def similar(a: str, b: str) -> bool:
    """One edit or swap of neighbours apart, or two in words of eight letters or more."""
    if a == b:
        return True
    short = min(len(a), len(b))
    most = 0 if short < 3 else 1 if short < 8 else 2
    return abs(len(a) - len(b)) <= most and distance(a, b, most) <= most


def distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between two words; above `most` just something above it."""
    if sum((Counter(a) - Counter(b)).values()) > most or sum((Counter(b) - Counter(a)).values()) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return row[-1]


VOCABULARY = Vocabulary()


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.replace("™", "").replace("®", ""))
    return MARKS.sub("", text)


def read_form(text: str | None, folder: bool = False, vocabulary: Vocabulary | None = None) -> dict | None:
    """Work, number, kind and hints of a name, or of a path's last folder; None if nothing is there.

    number: 0 if none is given, None if it can't be known (an opaque or cut name). core: the work's words in order.
    """
    if text is None:
        return None
    known = vocabulary or VOCABULARY
    text = _plain(text)
    if folder:
        parts = [p for p in SLASH.split(text) if WORD.search(p)]
        if not parts:
            return None
        text = FRAME.sub("", parts[-1])
        code = CODE.fullmatch(text.lower().replace(" ", ""))
        if code:
            return {"core": "", "number": None, "kind": "", "edition": "", "acronym": "", "code": code.group(1) + code.group(2), "cut": False}
        if not PARTED.search(text):
            text = CAMEL.sub(" ", GLUED_VERSION.sub("", text))
    cut = text.rstrip().endswith(("…", "..."))
    acronym = ""
    text = BRACKETED.sub(lambda m: " " if _is_tag(m.group(1), known) else f" {m.group(1)} ", text)
    bare = text.strip().rstrip("….")
    initials = INITIALS.fullmatch(bare)
    if not folder and initials and len(bare) <= 8:
        acronym = initials.group(1).lower()
    words = WORD.findall(VERSION.sub(" ", text.lower().replace("&", " and ")))
    edition = " ".join(sorted({w for w in words if w in known.editions and w != "edition"}))
    words = [w for w in words if w not in known.tags and w not in known.editions and not (w.isdigit() and len(w) == 4 and w[:2] in ("19", "20"))]
    core, number, kind = [], 0, ""
    for place, w in enumerate(words):
        if w in known.kind_of:
            kind = kind or known.kind_of[w]
        elif w.isdigit() and len(w) <= 2 and place:
            number = int(w)
        elif w in ROMAN and place and (w != "x" or place == len(words) - 1):
            number = ROMAN[w]
        elif near := known.misspelled(w):
            kind = kind or known.kind_of.get(near, "")
        else:
            core.append(w)
    if acronym:
        number = int(initials.group(2)) if initials.group(2) else 0
        core = []
    if not core and not acronym:
        return None
    return {"core": " ".join(core), "number": None if cut else number, "kind": kind, "edition": edition, "acronym": acronym, "code": "", "cut": cut}


def _is_tag(inner: str, known: Vocabulary) -> bool:
    words = WORD.findall(inner.lower())
    return all(w in known.tags or w in known.editions or w.isdigit() for w in words)


def content(core: str) -> list[str]:
    return [w for w in core.split() if w not in STOP]


def glued(core: str) -> set[str]:
    """The work's letters without spaces, with and without its small words."""
    words = core.split()
    return {"".join(words), "".join(w for w in words if w != "and"), "".join(w for w in words if w not in STOP)} - {""}


def initials_of(core: str) -> set[str]:
    words = core.split()
    return {"".join(w[0] for w in words), "".join(w[0] for w in words if w != "and"), "".join(w[0] for w in words if w not in STOP), "".join(w[0] for w in words if w not in ("the", "and"))} - {""}


def trimmed(core: str) -> list[str]:
    """A glued lower-case folder may end in a Roman number: the work without it, and that number."""
    if " " in core or len(core) < 10:
        return []
    return [core[: -len(r)] for r in ("viii", "vii", "iii", "ii", "iv", "vi", "v") if core.endswith(r)]


def block_keys(form: dict | None, other: dict | None, common: frozenset[str], repair: dict[str, set[str]], title: bool = False) -> list[str]:
    """Keys of all passes for one string of a record; `other` is the record's other string, for hints that need both."""
    keys: set[str] = set()
    if form is None:
        return []
    core = form["core"]
    if core:
        words = content(core)
        keys |= {"=" + g for g in glued(core)}
        keys |= {"=" + g for g in trimmed(core)}
        keys.add("~" + " ".join(sorted(words)))
        known = []
        for w in words:
            fixed = {w} if w in common else repaired(w, repair)
            # a word that may be either of two stands for none
            if len(fixed) == 1:
                known.append(min(fixed))
            if w not in common and len(w) >= 4:
                keys |= {"-" + x for x in deletions(w)}
        if len(known) > 1 and (len(known) == len(words) or (len(known) == len(words) - 1 and len(known) >= 3)):
            keys.add("+" + " ".join(sorted(known)))
            if title and len(known) >= 4:
                # a title is also found by all its common words but one
                keys |= {"+" + " ".join(sorted(known[:k] + known[k + 1 :])) for k in range(len(known))}
        hints = set()
        if other and other["code"] and other["code"] != "game":
            hints.add(other["code"].rstrip("0123456789"))
        first = core.split()[0] if not words else words[0]
        for h in hints:
            keys.add(f"@{h} {first if first in common else min(repaired(first, repair) or {first})}")
    return sorted(keys)


def title_keys(form: dict | None, common: frozenset[str], repair: dict[str, set[str]]) -> list[str]:
    """Keys of a title: as above, and each acronym it may be coded by, with its first word."""
    keys = set(block_keys(form, None, common, repair, True))
    if form and form["core"]:
        words = content(form["core"])
        if words:
            kind = {"demo": "d", "soundtrack": "s", "server": "ds"}.get(form["kind"], "")
            for h in {a + kind for a in initials_of(form["core"])}:
                keys |= {f"@{h} {w}" for w in (words[0], form["core"].split()[0])}
    return sorted(keys)


def repair_table(common: frozenset[str]) -> dict[str, set[str]]:
    table: dict[str, set[str]] = {}
    for w in common:
        if len(w) >= 4:
            for d in deletions(w):
                table.setdefault(d, set()).add(w)
    return table


def repaired(word: str, repair: dict[str, set[str]]) -> set[str]:
    """Common words one edit away."""
    if len(word) < 3:
        return set()
    return {w for d in deletions(word) for w in repair.get(d, ()) if similar(w, word)}


def paired(a: list[str], b: list[str], common: frozenset[str], cut: bool = False) -> tuple[float, list[str], list[str]]:
    """Share of letters in words that both have, in any order and up to small errors, and the words left over on each side.

    Two different common words are never one with an error. With `cut` the last word may be a beginning.
    """
    left, rest, same = list(b), [], 0
    for w in a:
        hit = w if w in left else next((x for x in left if similar(w, x) and not (w in common and x in common)), None)
        if hit is None and cut and w == a[-1] and len(w) > 1:
            hit = next((x for x in left if x.startswith(w) or (len(w) > 2 and similar(w, x[: len(w)]))), None)
        if hit is None:
            rest.append(w)
        else:
            left.remove(hit)
            same += len(w) + len(hit)
    total = sum(map(len, a)) + sum(map(len, b))
    return (same / total if total else 0.0), rest, left


# levels of agreement of a name or folder with a work: SIBLING agrees in words but names another number or kind; HINT is a code or
# acronym that fits while the other string names other words (initials fit many works, and by a block all in it, so they can't count alike)
MISSING, EXACT, NEAR, SHORT, CODED, PART, OTHER, CONFLICT, SIBLING, HINT = range(10)
#: The best of several spellings is taken in this order.
BETTER = {v: k for k, v in enumerate((CONFLICT, OTHER, MISSING, PART, SHORT, CODED, NEAR, EXACT))}
#: Levels at which a string gives the whole work, so that a number or kind it doesn't name isn't there.
FULL = frozenset((EXACT, NEAR, CODED))
# levels of number, kind and edition: what can't be known speaks neither way
UNKNOWN, NONE, SAME, DIFFER, ONE = range(5)


def level(form: dict | None, title: dict, common: frozenset[str]) -> int:
    """How a string of the other list agrees with a title."""
    if form is None or form["code"] == "game":
        return MISSING
    core = title["core"]
    if form["code"]:
        hint = form["code"].rstrip("0123456789")
        kind = {"demo": "d", "soundtrack": "s", "server": "ds"}.get(title["kind"], "")
        number = form["code"][len(hint) :]
        if hint in {a + kind for a in initials_of(core)} and (int(number) if number else 0) == (title["number"] or 0):
            return CODED
        return SHORT if hint in ("".join(core.split())[:4], core[:4].strip()) and not number else OTHER
    if form["acronym"]:
        return CODED if form["acronym"] in initials_of(core) else OTHER
    own, words = content(form["core"]), content(core)
    if sorted(own) == sorted(words) or glued(form["core"]) & glued(core):
        return EXACT
    if any(t in glued(core) for t in trimmed(form["core"])):
        return EXACT
    like, rest, left = paired(own, words, common, form["cut"])
    if like >= 0.85 and not (rest and left and rest[0] in common and left[0] in common):
        return NEAR
    a, b = "".join(own), "".join(words)
    most = max(1, min(3, len(b) // 7))
    differ = bool(rest) and bool(left) and any(w in common for w in rest) and any(w in common for w in left)
    if not differ and abs(len(a) - len(b)) <= most and distance(a, b, most) <= most:
        return NEAR
    if not rest and (own or form["core"] and core.startswith(form["core"])):
        return SHORT
    # what is left over must at least be damaged forms of each other
    if like >= 0.4 and not differ and rest and left and all(any(distance(w, x, max(1, len(x) * 2 // 5)) <= max(1, len(x) * 2 // 5) for x in left) for w in rest):
        return PART
    return CONFLICT if differ else OTHER


def best_level(form: dict | None, titles: list[dict], common: frozenset[str]) -> int:
    """The best agreement with any spelling (title or folder) of a game."""
    return max((level(form, t, common) for t in titles), key=BETTER.get)


def known_number(name: dict | None, folder: dict | None) -> int | None:
    """The number that the record gives: one that is named wins over none, which wins over what can't be known.

    Two different numbers contradict each other: -1.
    """
    given = {f["number"] for f in (name, folder) if f is not None and not f["code"] and f["number"] is not None}
    for f in (folder,):
        if f is not None and f["code"] and f["code"][-1:].isdigit():
            given.add(int(f["code"][-1]))
    named = given - {0}
    if len(named) > 1:
        return -1
    return named.pop() if named else 0 if given else None


def of_string(form: dict | None, best: int, title: dict) -> int:
    """The level of one string as a whole: SIBLING if it is of another number or kind of the same work."""
    if form is None or best in (MISSING, OTHER, CONFLICT) or form["code"]:
        return best
    whole, own, number = best in FULL and not form["cut"], title["number"] or 0, form["number"]
    glue = number == 0 and any(t in glued(title["core"]) for t in trimmed(form["core"]))
    if number is not None and number != own and not glue and (number or whole):
        return SIBLING
    return SIBLING if form["kind"] != title["kind"] and (form["kind"] or whole) else best


def compare(title: dict, path: dict | None, name: dict | None, folder: dict | None, common: frozenset[str]) -> tuple[int, int, int, int, int]:
    """Levels of name, folder, number, kind and edition. Nothing is decided here."""
    spellings = [title]
    if path is not None and path["core"] and path["core"] != title["core"]:
        spellings.append({**path, "number": title["number"], "kind": title["kind"]})
    one, two = best_level(name, spellings, common), best_level(folder, spellings, common)
    strings = [(f, v) for f, v in ((name, one), (folder, two)) if f is not None]
    whole = any(v in FULL and not f["cut"] for f, v in strings)

    kinds = {f["kind"] for f, _ in strings if f["kind"]}
    if kinds:
        kind = SAME if kinds == {title["kind"]} else DIFFER
    elif not title["kind"]:
        kind = NONE
    elif folder is not None and folder["code"] and two == CODED:
        kind = SAME
    else:
        kind = DIFFER if whole else UNKNOWN

    number, own = known_number(name, folder), title["number"] or 0
    glue = folder is not None and not folder["code"] and any(t in glued(title["core"]) for t in trimmed(folder["core"]))
    if number is None or (glue and number == 0):
        numbers = UNKNOWN
    elif number == own:
        numbers = SAME if own else NONE
    else:
        numbers = DIFFER if number or whole else UNKNOWN

    mine, theirs = {f["edition"] for f in (title, path) if f is not None and f["edition"]}, {f["edition"] for f, _ in strings if f["edition"]}
    edition = (SAME if mine & theirs else DIFFER) if mine and theirs else ONE if mine or theirs else NONE
    first, second = of_string(name, one, title), of_string(folder, two, title)
    if CODED in (one, two) and {one, two} & {OTHER, CONFLICT}:
        first, second = (HINT if v == CODED else v for v in (first, second))
    return first, second, numbers, kind, edition


#: Levels that speak against a match, by field; where EM starts, matches are the pairs without any.
AGAINST = (frozenset((OTHER, CONFLICT, SIBLING)), frozenset((OTHER, CONFLICT, SIBLING)), frozenset((DIFFER,)), frozenset((DIFFER,)), frozenset())
#: Levels that speak neither way.
SILENT = (frozenset((MISSING,)), frozenset((MISSING,)), frozenset((UNKNOWN,)), frozenset((UNKNOWN,)), frozenset())
FIELDS = ("name", "folder", "number", "kind", "edition")


def em(patterns: list[tuple[tuple[int, ...], int]], others: dict[tuple[int, ...], int] | None = None, rounds: int = 200) -> tuple[dict[tuple[int, ...], float], float, list[dict[int, tuple[float, float]]]]:
    """Posterior of each pattern, share of matches, and m and u of each field's levels, from counts of patterns.

    It starts from the pairs in which nothing disagrees; no chance is set by hand. others: counts of pairs drawn at random, which are
    no matches. Without them u would come from pairs of one block alone, which are alike in something.
    """
    if not patterns:
        return {}, 0.0, []
    others = others or {}
    counts = np.array([n for _, n in patterns], dtype=float)
    post = np.array([0.01 if any(v in bad for v, bad in zip(p, AGAINST)) else 0.9 for p, _ in patterns])
    tables: list[dict[int, tuple[float, float]]] = []
    share = 0.5
    for _ in range(rounds):
        match, rest = counts * post, counts * (1 - post)
        share = float(np.clip(match.sum() / counts.sum(), 1e-4, 0.999))
        tables, ratio = [], np.full(len(patterns), np.log(share / (1 - share)))
        for f, silent in enumerate(SILENT):
            levels = np.array([p[f] for p, _ in patterns])
            heard = [v for v in sorted(set(levels.tolist())) if v not in silent]
            # a twentieth of a pair more at each level, so that none is impossible
            m = {v: float(match[levels == v].sum()) + 0.05 for v in heard}
            u = {v: float(rest[levels == v].sum()) + sum(n for p, n in others.items() if p[f] == v) + 0.05 for v in heard}
            total_m, total_u = sum(m.values()), sum(u.values())
            tables.append({v: (m[v] / total_m, u[v] / total_u) for v in heard})
            for v, (a, b) in tables[-1].items():
                ratio[levels == v] += np.log(a / b)
        new = 1 / (1 + np.exp(-np.clip(ratio, -40, 40)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return {p: float(v) for (p, _), v in zip(patterns, post)}, share, tables


_ARROW_FORM = pa.struct([("core", pa.string()), ("number", pa.int32()), ("kind", pa.string()), ("edition", pa.string()), ("acronym", pa.string()), ("code", pa.string()), ("cut", pa.bool_())])


def _reader(folder: bool, vocabulary: Vocabulary):
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([read_form(t, folder, vocabulary) for t in texts.to_pylist()], _ARROW_FORM)

    return F.arrow_udf(read, FORM)


def _tasks(df: DataFrame) -> int:
    return max(tasks_of(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)


def _forms(df: DataFrame, key: str, name: str, folder: str, vocabulary: Vocabulary) -> DataFrame:
    """Distinct (id, form, a, b): the two strings of each record read, and a hash of what was read."""
    rows = df.select(F.col(key).alias("id"), F.col(name).alias("name"), F.col(folder).alias("folder")).where("id is not null").distinct()
    # repeated rows are combined first; a stated number of partitions keeps Spark from merging them into a few tasks of Python work
    rows = rows.repartition(_tasks(df), "id", "name", "folder").select("id", _reader(False, vocabulary)("name").alias("a"), _reader(True, vocabulary)("folder").alias("b"))
    # a record with nothing to read in either string can't be linked
    rows = rows.where("a is not null or b is not null")
    return rows.withColumn("form", F.xxhash64("a", F.lit("|"), "b", F.col("a").isNull(), F.col("a.number").isNull(), F.col("b.number").isNull())).distinct()


def link_records(left: DataFrame, right: DataFrame, left_columns: tuple[str, str, str] = ("id", "title", "path"), right_columns: tuple[str, str, str] = ("id", "name", "directory"), least: float = 0.5, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """(left_id, right_id, confidence) of records that are the same game; columns: id, name and folder of each side.

    Left names are titles as recorded, right ones may be typed, cut, coded or missing. A left record without a title is known by
    its folder. Records with neither string, or null ids, are in no link; repeated rows count once; if ids have several
    spellings, the best counts. Empty tables give no links. A link is a pair whose posterior is `least` or more, by no other rule.
    """
    works, records, titles, entries, compared = compared_forms(left, right, left_columns, right_columns, vocabulary)
    posterior, _, _ = em(*pattern_counts(compared))
    # one row for each pattern of levels, some hundreds
    table = left.sparkSession.createDataFrame([(*p, v) for p, v in posterior.items() if v >= least], ", ".join(f"{f} int" for f in FIELDS) + ", confidence double")
    good = compared.where("blocked").join(F.broadcast(table), list(FIELDS)).select("work", "record", "confidence")
    ids = good.join(titles.select(F.col("form").alias("work"), F.col("id").alias("left_id")).hint("merge"), "work").join(entries.select(F.col("form").alias("record"), F.col("id").alias("right_id")).hint("merge"), "record")
    return ids.groupBy("left_id", "right_id").agg(F.max("confidence").alias("confidence"))


def pattern_counts(compared: DataFrame) -> tuple[list[tuple[tuple[int, ...], int]], dict[tuple[int, ...], int]]:
    """Patterns of levels with their pairs: of those that share a block, and of those drawn at random."""
    rows = compared.groupBy(*FIELDS, "blocked").agg(F.count(F.lit(1)).alias("n")).collect()
    of = {b: [(tuple(r[f] for f in FIELDS), r["n"]) for r in rows if r["blocked"] == b] for b in (True, False)}
    return of[True], dict(of[False])


def compared_forms(left: DataFrame, right: DataFrame, left_columns: tuple[str, str, str], right_columns: tuple[str, str, str], vocabulary: Vocabulary = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Distinct forms of both sides, their ids, and (work, record, blocked, levels of FIELDS) of every pair that shares a block, and
    of about one other pair a record, drawn by hash."""
    spark = left.sparkSession
    titles = _forms(left, *left_columns, vocabulary).withColumn("a", F.coalesce("a", F.when((F.col("b.code") == "") & (F.col("b.core") != ""), F.col("b")))).where("a is not null")
    titles = checkpointed(titles)
    entries = checkpointed(_forms(right, *right_columns, vocabulary))
    tasks = _tasks(left)
    works, records = (checkpointed(df.select("form", "a", "b").repartition(tasks, "form").dropDuplicates(["form"])) for df in (titles, entries))

    cores = works.select(F.col("a.core").alias("core")).unionAll(records.select("a.core")).unionAll(records.select("b.core")).where("core != ''").distinct()
    words = cores.select(F.explode(F.array_distinct(F.split("core", " "))).alias("word")).where(~F.col("word").isin(*STOP) & (F.col("word") != ""))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # each of these stands in one work of 1 / COMMON, so there are at most words-per-title / COMMON
    common = frozenset(r["word"] for r in counted.where(F.col("n") >= max(COMMON_LEAST, cores.count() * COMMON)).collect())
    sent = spark.sparkContext.broadcast(common)
    made: list[dict[str, set[str]]] = []

    def repair() -> dict[str, set[str]]:
        if not made:
            made.append(repair_table(sent.value))
        return made[0]

    @F.arrow_udf("array<string>")
    def of_titles(a: pa.Array, b: pa.Array) -> pa.Array:
        table = repair()
        return pa.array([sorted({*title_keys(x, sent.value, table), *title_keys(y, sent.value, table)}) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def of_entries(a: pa.Array, b: pa.Array) -> pa.Array:
        table = repair()
        return pa.array([sorted({*block_keys(x, y, sent.value, table), *block_keys(y, x, sent.value, table)}) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.string()))

    @F.arrow_udf("struct<name:int,folder:int,number:int,kind:int,edition:int>")
    def levels(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = [compare(*row, sent.value) for row in zip(*(x.to_pylist() for x in (a, b, c, d)))]
        columns = zip(*rows) if rows else [[]] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in columns], list(FIELDS))

    # read twice each: to plan the join, and by it
    left_keys = checkpointed(works.select(F.col("form").alias("work"), F.explode(of_titles("a", "b")).alias("key")))
    right_keys = records.select(F.col("form").alias("record"), F.explode(of_entries("a", "b")).alias("key"))
    pairs = fragment_replicate_join(left_keys, right_keys, [("key", "key")], by=["work"]).select("work", "record", F.lit(True).alias("blocked"))
    buckets = F.lit(max(works.count(), 1))
    drawn = works.select(F.col("form").alias("work"), F.pmod(F.xxhash64("form"), buckets).alias("bucket")).join(records.select(F.col("form").alias("record"), F.pmod(F.xxhash64("form", F.lit(1)), buckets).alias("bucket")).hint("merge"), "bucket")
    pairs = pairs.unionAll(drawn.select("work", "record", F.lit(False))).groupBy("work", "record").agg(F.bool_or("blocked").alias("blocked"))
    # forms and ids grow with the data, and estimates after a checkpoint are too low: these joins are merged, never broadcast
    both = pairs.join(works.select(F.col("form").alias("work"), F.col("a").alias("ta"), F.col("b").alias("tb")).hint("merge"), "work")
    both = both.repartition(tasks, "record").join(records.select(F.col("form").alias("record"), F.col("a").alias("ra"), F.col("b").alias("rb")).hint("merge"), "record")
    compared = checkpointed(both.select("work", "record", "blocked", levels("ta", "tb", "ra", "rb").alias("v")).select("work", "record", "blocked", "v.*"))
    return works, records, titles, entries, compared
