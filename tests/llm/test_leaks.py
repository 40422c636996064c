import random
import unicodedata
from collections import Counter
from itertools import combinations

import regex

from stowage.llm import leaks

STEMS = "the pass over store kept every frame while nobody asked index wrote layer near folder before after because without under archive budget ledger worker sample".split()


def item(rng, words=40):
    return " ".join(rng.choice(STEMS) if rng.random() < 0.75 else "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize() for _ in range(words))


def noisy(rng, words, share):
    out = list(words)
    for at in rng.sample(range(len(out)), int(len(out) * share)):
        out[at] = rng.choice([out[at][::-1], "", "other", out[at][:-1] + "q"])
    return [w for w in out if w]


def filler(rng, n):
    return " ".join(rng.choice(STEMS) if rng.random() < 0.7 else "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def search(spark, items, texts):
    """The items that each text leaks."""
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = [[] for _ in texts]
    for doc, found in leaks.leaked_items(d, i).collect():
        out[doc].append(found)
    return [sorted(x) for x in out]


def test_recall_and_precision_on_planted_passages(spark):
    rng = random.Random(11)
    items = [(i, item(rng)) for i in range(60)]
    want, texts = [], []
    for _ in range(150):
        i = rng.randrange(60)
        words = items[i][1].split()
        size = rng.randrange(16, 30)
        start = rng.randrange(len(words) - size)
        passage = noisy(rng, words[start : start + size], 0.15)
        texts.append(filler(rng, rng.randrange(300)) + ". " + " ".join(passage).upper() + "! " + filler(rng, rng.randrange(300)))
        want.append([i])
    got = search(spark, items, texts)
    assert all(set(g) <= set(w) for g, w in zip(got, want))
    assert sum(g == w for g, w in zip(got, want)) >= 0.95 * len(want)


KINDS = {"left out": lambda rng, w: "", "another": lambda rng, w: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)), "misspelled": lambda rng, w: w[:2] + w[3:] if len(w) > 4 else w + "q"}


def test_recall_at_the_limit_in_real_documents(spark):
    """Passages of 14 to 40 words with none, 10 % and 20 % of one kind of change, in the middle of documents that leak nothing."""
    d = "/root/testdata/sf0.01"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "text").collect() if r["text"]]
    documents = spark.read.parquet(f"{d}/documents.parquet").where("text is not null and kind != 'manifest' and length(text) between 200 and 3000").select("doc_id", "text")
    leaking = leaks.leaked_items(documents, spark.createDataFrame(items, "item_id long, text string"))
    clean = [r["text"] for r in documents.join(leaking, "doc_id", "left_anti").orderBy("doc_id").limit(200).collect()]
    rng, cells, texts, sure = random.Random(2), [], [], []
    own = [(i, leaks.words(t)) for i, t in items]
    own = [(i, w) for i, w in own if len(w) >= 50 and not any(map(leaks.is_wide, w))]
    seen = Counter(w for _, t in items for w in set(leaks.words(t)))
    for size in (14, 20, 28, 40):
        for share in (0, 0.1, 0.2):
            for kind, change in KINDS.items():
                for _ in range(40):
                    i, words = rng.choice(own)
                    start = rng.randrange(len(words) - size + 1)
                    places = set(rng.sample(range(size), int(size * share)))
                    passage = [change(rng, w) if k in places else w for k, w in enumerate(words[start : start + size])]
                    text = rng.choice(clean)
                    at = text.find(" ", len(text) // 2)
                    texts.append(text[:at] + "\n" + " ".join(w for w in passage if w) + ".\n" + text[at:])
                    cells.append((size, share, kind, i))
                    # without one of its own words a passage is told from none made of the same phrases
                    sure.append(any(seen[w] == 1 for k, w in enumerate(words[start : start + size]) if k not in places))
    got = search(spark, items, texts)
    hits, whole = Counter(), Counter()
    for cell, found, told in zip(cells, got, sure):
        assert set(found) <= {cell[3]}, cell
        if told:
            whole[cell[:3]] += 1
            hits[cell[:3]] += cell[3] in found
    assert all(hits[c] >= 0.95 * n for c, n in whole.items()), {c: (hits[c], n) for c, n in whole.items() if hits[c] < 0.95 * n}
    assert sum(whole.values()) > 0.95 * len(texts)


def changed(words, places):
    """The words with some changed (even places) or left out (odd ones)."""
    return [w if i not in places else "qqxy" if i % 2 == 0 else "" for i, w in enumerate(words)]


def test_one_word_in_five_anywhere(spark):
    rng = random.Random(3)
    items = [(i, item(rng)) for i in range(12)]
    words = items[7][1].split()

    def text(start, size, places):
        return filler(rng, 40) + " " + " ".join(changed(words[start : start + size], places)) + " " + filler(rng, 40)

    cases = [(14, (i,)) for i in range(14)] + [(14, pair) for pair in combinations(range(14), 2)]
    cases += [(15, (2, 7, 8)), (15, (3, 8, 9)), (15, (4, 6, 8)), (16, (2, 3)), (16, (3, 4)), (20, (4, 5, 9, 10)), (20, (3, 7, 11, 15)), (20, (5, 7, 10, 12))]
    asked = [(size, places, start) for size, places in cases for start in (0, 10, 11, 12, 13, 14)]
    got = search(spark, items, [text(start, size, places) for size, places, start in asked])
    assert [a for a, g in zip(asked, got) if g != [7]] == []
    assert search(spark, items, [text(10, size, places) for size, places in [(11, ()), (14, (3, 7, 10)), (14, (2, 6, 8)), (15, (3, 6, 9, 11))]]) == [[]] * 4


def test_one_character_in_five_anywhere():
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(900)]
    items = [(i, "".join(rng.sample(letters, 90))) for i in range(5)]
    third = leaks.Item(leaks.words(items[3][1]), set())
    for places in [(i, j) for i in range(0, 40, 3) for j in range(i + 1, 40, 5)] + [(1, 2, 3, 4, 35, 36, 37, 38)]:
        assert third.lies_in(leaks.words("".join("丂" if i in places else c for i, c in enumerate(items[3][1][20:60])))), places
    assert not third.lies_in(leaks.words(items[3][1][20:51]))
    assert not third.lies_in(leaks.words("".join("丂" if i in range(1, 37, 4) else c for i, c in enumerate(items[3][1][20:60]))))


def test_one_own_word_is_enough():
    common = "the pass over store kept every frame while nobody asked index wrote layer near folder before after because".split()
    own = ["Vobara", "Kemigu", "Zoripa", "Dulofe"]
    text = common[:4] + own[:1] + common[4:5] + own[1:2] + common[5:6] + own[2:3] + common[6:7] + own[3:] + common[7:12]
    first = leaks.Item(leaks.words(" ".join(text)), {w.lower() for w in own})
    assert len(text) == 16
    assert first.lies_in(leaks.words(" ".join("qqx" if w in own[1:] else w for w in text)))
    assert not first.lies_in(leaks.words(" ".join("qqx" if w in own else w for w in text)))


def test_what_is_no_leak(spark):
    rng = random.Random(5)
    items = [(i, item(rng)) for i in range(20)]
    words = items[3][1].split()
    shuffled = words[:]
    rng.shuffle(shuffled)
    texts = [" ".join(words[5:13]), " ".join(shuffled), filler(rng, 3000), "", None, "one", " ", "\x1e\x1e"]
    assert search(spark, items, texts) == [[]] * len(texts)


def test_form_does_not_matter(spark):
    rng = random.Random(7)
    items = [(i, item(rng)) for i in range(20)]
    words = items[4][1].split()[3:25]
    texts = ["<b>" + "</b> &nbsp; **".join(words), "\r\n".join(words).upper(), ", ".join(chr(0xFF21 + ord(w[0].upper()) - 65) + w[1:] for w in words), " ".join(w[0] + "\u00ad" + w[1:] for w in words)]
    assert search(spark, items, texts) == [[4]] * 4


def test_wide_scripts(spark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(400)]
    items = [(i, "".join(rng.choice(letters) for _ in range(60)) + f"Kilo{i}rano" + "".join(rng.choice(letters) for _ in range(60))) for i in range(10)]
    noise = "".join(rng.choice(letters) for _ in range(500))
    # also where most of the document is in words
    assert search(spark, items, [noise + items[2][1][30:95] + "。", items[2][1][50:70], filler(rng, 400) + items[5][1][20:75] + filler(rng, 400)]) == [[2], [], [5]]


def test_words_are_cut_as_one_by_one():
    """All texts at once give the words of a regular expression over each."""
    token = regex.compile(rf"[{leaks.WIDE}]|\p{{N}}+(?:[.,]\p{{N}}+)*|[\p{{L}}\p{{M}}\p{{N}}--[{leaks.WIDE}]]+", regex.V1)
    rng = random.Random(1)
    alphabet = "ab19.,- \n漢か한дφñé’'\u00ad\u0301①½ß#_ाहि"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    tokens = leaks.Tokens(texts)
    for k, text in enumerate(texts):
        plain = regex.sub(r"[\p{Cf}\p{Mn}'’ʼ`´]+", "", unicodedata.normalize("NFKD", text).casefold())
        want = [w.translate(leaks.LOOKALIKE) if regex.match(r"(?=.*\p{Latin})(?=.*[\p{Cyrillic}\p{Greek}])", w) else w for w in token.findall(plain)]
        got = tokens.words(tokens.offsets[k], tokens.offsets[k + 1])
        assert got == want, text
        assert (leaks.hashes_of(got) == tokens.hashes[tokens.offsets[k] : tokens.offsets[k + 1]]).all(), text


def test_rows(spark):
    rng = random.Random(13)
    items = [(i, item(rng)) for i in range(12)]
    docs = [(1, filler(rng, 50) + " " + items[2][1], "x"), (2, None, "x"), (3, "", "x"), (4, items[5][1] + " " + items[6][1], "x"), (4, items[5][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    want = [(1, 2), (4, 5), (4, 5), (4, 6)]
    assert sorted(map(tuple, leaks.leaked_items(d, i).collect())) == want
    assert leaks.leaked_items(d, i.where("item_id < 0")).collect() == [] and leaks.leaked_items(d.where("doc_id < 0"), i).collect() == []


def test_items_in_several_groups(spark, monkeypatch):
    rng = random.Random(13)
    items = [(i, item(rng)) for i in range(12)]
    d = spark.createDataFrame([(1, items[2][1]), (2, items[7][1])], "doc_id long, text string")
    monkeypatch.setattr(leaks, "GROUP_TOKENS", 100)
    monkeypatch.setattr(leaks, "ITEM_PIECE", 10)
    assert sorted(map(tuple, leaks.leaked_items(d, spark.createDataFrame(items, "item_id long, text string")).collect())) == [(1, 2), (2, 7)]
