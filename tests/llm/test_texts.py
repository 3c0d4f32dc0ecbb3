import random

import numpy as np
import pytest

from ledgerloom.llm import encode, leaks, pages, sentences

BOX = "array<struct<x:int,y:int,w:int,h:int,conf:float>>"
DOCS = f"doc_id bigint, text string, lines {BOX}, ids string, end_pos string"


def page(*lines, x=80, y=100):
    """Text and boxes of lines given as text or (text, kind, column)."""
    text, boxes, tops = [], [], {0: y, 1: y}
    for row in lines:
        s, kind, column = row if isinstance(row, tuple) else (row, "body", 0)
        h, dx = {"body": (24, 0), "head": (52, 0), "advert": (17, 43)}[kind]
        boxes.append((x + 640 * column + dx, tops[column], 12 * len(s), h, 90.0))
        tops[column] += 58 if kind == "head" else 30
        text.append(s)
    return "\n".join(text), boxes


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, b, None, None) for i, (t, b) in enumerate(rows)], DOCS)


EDGE = [(None, None), ("", []), (" \n ", []), ("no boxes. At all.", None), ("a " * 150_000, None)]

# Encoding --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(f"{encode.FOLDER}/{encode.VOCABULARY}.tiktoken")


def encoded(encoder, texts):
    ids, sizes = encoder.texts(texts)
    return [a.tolist() for a in np.split(np.frombuffer(ids, "<i4"), np.cumsum(sizes)[:-1])] if texts else []


def test_chunks_equal_whole_texts(encoder):
    random.seed(7)
    letters = list("ab 'st\n\r\t\xa0　é1.…ก่漢字अि 's <|endoftext|>") + ["the ", "don't ", "\n\n", "   ", "<|endoftext|>"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 200))) for _ in range(1500)]
    assert encoded(encoder, texts) == [encoder._encode(t) for t in texts]


@pytest.mark.parametrize("spacing", [1, 3, 1000])
def test_joins_are_repaired(encoder, spacing, monkeypatch):
    """Cuts fall anywhere, also in scripts without blanks; few joins hold as they are, all equal the whole text at the end."""
    monkeypatch.setattr(encode, "SPACING", spacing)
    encoder._chunks.clear(), encoder._seams.clear()
    random.seed(8)
    texts = ["".join(random.choice("港口的市長說話一二三、。") for _ in range(400)), "unbelievable " * 40, "don't" * 60, "ประชาชนในเมืองท่า" * 20, "x" * 500, "'" * 90]
    for _ in range(2):  # the second time from the cache, between other neighbours
        random.shuffle(texts)
        assert encoded(encoder, texts) == [encoder._encode(t) for t in texts]
    if spacing == 3:
        joins, repaired, chunks = map(list, zip(*map(encoder.joins, texts)))
        assert 30 < sum(repaired) <= sum(joins) and ["".join(c) for c in chunks] == texts


def test_shared_chunks(spark, encoder):
    text = "The mill of Zoll opened the port and the harbour was calm on that day. " * 30
    (r,) = encode.reuse(docs(spark, (text, None), (text, None)).selectExpr("*", "'en' AS lang")).collect()
    assert r.documents == 2 and r.chunks >= 2 * r.distinct_chunks > 0 and r.joins >= r.repaired > 0
    assert [r.asDict() for r in encode.reuse(docs(spark, (None, None)).selectExpr("*", "CAST(NULL AS string) AS lang")).collect()] == [
        {"lang": None, "documents": 1, "chunks": 0, "distinct_chunks": 0, "joins": 0, "repaired": 0}
    ]


def test_encoded_frame(spark, encoder):
    rows = [*EDGE, ("<|endoftext|>", None), ("ab", None), ("ab", None)]
    got = {r.doc_id: r.ids for r in encode.encoded(docs(spark, *rows)).collect()}
    assert got == {i: encoder._encode(t) if t else [] for i, (t, _) in enumerate(rows)}
    assert encode.encoded(docs(spark, *EDGE).limit(0)).count() == 0


def test_other_vocabulary(spark):
    got = encode.encoded(docs(spark, ("Ein Text", None)), vocabulary="byte_bpe_multi_50k").first().ids
    assert got == encode.Encoder(f"{encode.FOLDER}/byte_bpe_multi_50k.tiktoken")._encode("Ein Text")


def test_whole_corpus(spark, data, encoder):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: encoder._encode(r.text or "") for r in rows.select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in encode.encoded(rows).collect()} == want


# Pages ------------------------------------------------------------------------------


def test_reading_order():
    import pyarrow as pa

    mixed = page(("HEAD", "head", 0), ("c1 b", "body", 1), ("c0 a", "body", 0), ("Tel. 3", "advert", 0), ("c0 b", "body", 0), ("NEXT", "head", 1), ("c1 c", "body", 1))
    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("conf", pa.float32())]))
    boxes = pa.array([[dict(zip("x y w h conf".split(), b)) for b in mixed[1]], None, []], kind)
    got = pages.articles(pa.array([mixed[0], "x\ny", ""]), boxes)
    assert [[a.text for a in p] for p in got] == [["c0 a\nc0 b\nc1 b", "c1 c"], ["x\ny"], []]
    a = got[0][0]
    for end in range(1, len(a.text) + 1):
        if a.text[end - 1] != "\n":
            assert mixed[0][a.position(end) - 1] == a.text[end - 1]


# Sentences ----------------------------------------------------------------------------

FILLER = {
    "en": "The mill of Zoll opened the port. It is late! It is said that Capt. Moll came. The ship sank? The port of Capt. Vond slept. In June Capt. Toll left. It rained! The end? Capt. Wurt ran. Mr. Lund saw that of the mill. The sea of Mr. Bend was calm! ",
    "de": "Der Hafen von Zoll war leer! Die Mühle und der Markt? Der Zeuge lobte Prof. Moll. Die Schule! Der Markt von Prof. Vond. Die Firma & Co. lobte den Hafen. Der Richter? ",
}


@pytest.fixture(scope="module")
def stats(spark):
    rows = [(FILLER[k] * 12, None) for k in FILLER]
    return sentences.corpus_statistics(docs(spark, *rows))


def cut(text, stats, script=None):
    found = list(sentences._ends(text, script or sentences.script_of(text), stats))
    return [text[a:b].strip() for a, b in zip([0, *found], found)]


def test_speaker_words_are_learned(spark):
    """From what follows closed quotations, and hardly any other sentence."""
    zh = "「船走了吗？」查市长。本地港口很大。海上起风了！市长来了？「你好！」查他。星期天开会。" * 20
    hi = "“कौन है?” बताया उसने। नगर बड़ा है। नगर सुंदर है! “चलो!” बताया राम ने। आज वर्षा हुई। " * 20
    got = sentences.corpus_statistics(docs(spark, (zh, None), (hi, None))).speakers
    assert got == {"zh": ("查",), "hi": ("बताया",)}
    learned = sentences.Statistics(speakers=got)
    assert cut("「船走了吗？」查市长。海上起风了！", learned, "zh") == ["「船走了吗？」查市长。", "海上起风了！"]
    assert cut("「船走了吗？」问市长。", sentences.Statistics(), "zh") == ["「船走了吗？」问市长。"]  # a corpus without quotations


def test_words_of_any_length():
    word = "Bundes" * 20
    assert sentences._last(f"das {word}", 4 + len(word)) == word and sentences._last("a " + "x" * 201, 203) == "" and sentences._last("", 0) == ""
    assert sentences._word_after(f" {word}-\n{word} x", 0) == word + word and sentences._word_after(" (", 0) == ""


def test_titles_come_from_the_corpus(stats):
    assert "capt" in stats.before_names["en"] and "prof" in stats.before_names["de"] and "the" in stats.starters["en"]
    assert "port" not in stats.before_names["en"]


@pytest.mark.parametrize(
    "parts",
    [
        ["The ship of Capt. Moll came at 7.30 p.m. to the port.", "It cost $1,354.33 in all!", "The end?"],
        ["The mill of J. S. Zoll & Co. was open.", "The port was at 7.30 p.m. the best."],
        ["The port was sold on Monday last, at a cost of 98.46.", "The mill of Zoll was shut."],
        ['"It is late!"', '"The mill was old?" asked the man.', "The end."],
        ["“It is late.", "The mill of Zoll is shut!”", "It is the end."],
        ["The public… mill of Zoll was the... best.", "It was the end."],
        ["The mill of Zoll was shut etc.", "The port was open."],
        ["The mill was shut !", "The port was the best ."],
        ["The mill was shut?", "Capt. Lund was at the port of Zoll."],
    ],
)
def test_english(stats, parts):
    assert cut(" ".join(parts), stats) == parts
    assert cut("\n".join(parts), stats) == parts


def test_cut_off_and_german(stats):
    assert cut("The mill of Zoll was shut. The port was at the", stats) == ["The mill of Zoll was shut."]
    assert cut("The mill of Zoll was seen by Capt.", stats) == []
    text = "Der Hafen von Zoll lobte am 8. Mai den Markt. »Die Mühle und der Markt?« fragte Prof. Moll. Die Firma Zoll & Co. lobte den Hafen."
    assert cut(text, stats) == ["Der Hafen von Zoll lobte am 8. Mai den Markt.", "»Die Mühle und der Markt?« fragte Prof. Moll.", "Die Firma Zoll & Co. lobte den Hafen."]


def test_the_page_decides_before_the_corpus():
    """Titles, abbreviations and names from other articles of the page, without or against the corpus."""
    article = lambda text, at: pages.Article(text, [0], [at])
    other = "The man saw Moll at the mill of Zoll & Co., and the sea near Lund was calm. By the sea Capt. Moll and Capt. Lund came."
    text = "The port of Zoll & Co. Lund was old. It was Capt. Moll of the port."
    page = [article(other, 0), article(text, 1000)]
    ends = [75, len(other), 1000 + text.index("old.") + 4, 1000 + len(text)]
    assert other[:75].endswith("calm.") and sentences.sentence_ends(page, sentences.Statistics()) == ends
    wrong = sentences.Statistics(before_names={"en": frozenset({"port"})})
    assert cut("The port was old. All men of the mill left the port. Moll came.", wrong) == ["The port was old.", "All men of the mill left the port.", "Moll came."]


@pytest.mark.parametrize(
    ("script", "parts"),
    [
        ("zh", ["据安平先生说，3.93元。", "「收成以3,241.69元？」问林安镇。", "“旧的？”", "……新的！"]),
        ("ja", ["寺は3.85円で買った。", "「島が直した？」と尋ねた。", "橋は、古い！"]),
        ("hi", ["पं. Zaton ने 6.14 रुपये दिये।", "“नया स्टेशन खोला गया?” पूछा W. M. Cerk।", "गया!"]),
        ("ar", ["«دفع 2.48 ثمن الباخرة؟» سأل Tolawick.", "قيل إن الميناء زار السوق.", "دفع 4.65؟"]),
        ("ru", ["В 1936 г. осенью театр починил мост.", "«Школа близ Zoll?» спросил купец."]),
    ],
)
def test_scripts(script, parts):
    text = " ".join(parts)
    known = sentences.Statistics(starters={"ru": frozenset({"в"})})
    assert sentences.script_of(text) == script
    assert cut(text, known) == parts


def test_thai_ends_before_spaces():
    text = "ครั้งที่สามโกดังที่สพชบุรีขนพ่อค้า ทยจทบุรีและโรงเรียนปิดธนาคาร \nใกล้วัด"
    assert [text[:e] for e in sentences._ends(text, "th", sentences.Statistics())] == [text.split(" ")[0], text[: text.index(" \n")]]


def test_frame(spark):
    body = page(("THE HEAD.", "head", 0), "The port of Zoll was at the", ("Sold here. Tel. 3.", "advert", 0), "mill. The end", "was near! The")
    got = {}
    for r in sentences.sentences(docs(spark, body, body, *EDGE)).collect():
        got.setdefault(r.doc_id, []).append(r.end_pos)
    want = [body[0].index("mill.") + 5, body[0].index("near!") + 5]
    assert got[0] == got[1] == want and got[5] == [9, 17] and set(got) == {0, 1, 5}
    assert sentences.sentences(docs(spark, *EDGE).limit(0)).count() == 0


# Leaks --------------------------------------------------------------------------------


def test_suffix_array_and_index():
    random.seed(8)
    for size in (1, 2, 30, 400):
        tokens = np.array([random.choice([0, 1, 1, 1, 2, 3]) for _ in range(size)] + [0], np.int64)
        order = leaks.suffix_array(tokens, tokens == 0)
        symbols = [(0, i) if t == 0 else (1, t) for i, t in enumerate(tokens.tolist())]
        assert order.tolist() == sorted(range(size + 1), key=lambda i: symbols[i:])
        index = leaks.FMIndex(tokens, 4)
        phrases = np.array([[random.randint(1, 3) for _ in range(3)] for _ in range(40)])
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), lo.tolist(), hi.tolist()):
            want = [i for i in range(size - 1) if tokens[i : i + 3].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


PASSAGE = "the ancient inquest damaged the wooden cottage during the storm while Waesuton of Laenom rejected the brewery and the northern bridge near old Kleirark church on a Monday"
ITEMS = "item_id bigint, suite string, lang string, text string, doc_id int"


def leaked(spark, texts, items):
    rows = [t if isinstance(t, tuple) else (t, None) for t in texts]
    frame = spark.createDataFrame([(i, "s", "en", t, None) for i, t in enumerate(items)], ITEMS)
    return sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs(spark, *rows), frame).collect())


def test_leaks(spark):
    words = PASSAGE.split()
    other = "a farmer walked to the public market of Zoll and bought seven heavy horses before noon"
    misread = PASSAGE.replace("wooden", "woodcn").replace("bridge", "bridqe").replace("storm", "ftorm").upper()
    broken = "Some text. The ancient inquest damaged the woo-\nden cottage during the storm, while Waesuton of Lae=\nnom rejected the brewery and the northern bridge! And more."
    shuffled = words[:]
    random.Random(9).shuffle(shuffled)
    advert = page(" ".join(words[:11]), ("TO LET, six rooms", "advert", 0), " ".join(words[11:]))
    texts = [PASSAGE, f"{other} {misread} {other}", broken, " ".join(shuffled), " ".join(words[:19]), " ".join(words[3:24]), advert, " ".join(words[14:] + words[:14]), None, "", other]
    got = leaked(spark, texts, [PASSAGE, f"{PASSAGE} and more", other, None, "", "two words"])
    assert {d for d, i in got if i == 0} == {0, 1, 2, 5, 6}
    assert {d for d, i in got if i == 1} == {0, 1, 2, 5, 6}  # a shared passage counts for both
    assert leaked(spark, [], [PASSAGE]) == [] and leaked(spark, [PASSAGE], []) == []


def test_recall_over_misreading():
    """Runs of 20 to 30 words, each word misread by a letter at some rate."""
    random.seed(11)
    syllables = ["ka", "lo", "mi", "ne", "tur", "sab", "wen", "dro", "pil", "gar", "hes", "vo"]
    names = ["".join(random.choices(syllables, k=random.randint(2, 4))) for _ in range(900)]
    items = [(i, "en", " ".join(random.choices(names, k=random.randint(30, 60)))) for i in range(200)]
    block = leaks.prepared(items)

    def misread(w):
        k = random.randrange(len(w))
        return w[:k] + random.choice("cefthbnu") + w[k + 1 :]

    for rate in (0.05, 0.1, 0.15, 0.2, 0.25):
        pages = []
        for _, _, text in items:
            ws = text.split()
            a = random.randint(0, len(ws) - 30)
            pages.append([misread(w) if random.random() < rate else w for w in ws[a : a + random.randint(20, 30)]])
        found = {(d, i) for d, i, _, _ in leaks.find(pages, [False] * len(pages), lambda: [block])}
        assert sum((k, k) in found for k in range(len(items))) >= 0.9 * len(items), rate
        assert all(d == i for d, i in found)


def test_pages_of_mixed_scripts(spark):
    random.seed(12)
    chinese = "".join(chr(0x4E00 + random.randint(0, 3000)) for _ in range(300))
    zh, en = chinese[:80], PASSAGE
    frame = spark.createDataFrame([(1, "s", "en", en, None), (2, "s", "zh", zh, None)], ITEMS)
    rows = [f"{chinese[80:]}\n{en}\n{chinese[80:200]}", f"{en}\n{zh}", f"{' '.join(reversed(en.split()))} {zh}"]
    got = leaks.leaks(docs(spark, *((t, None) for t in rows)), frame)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 1), (1, 1), (1, 2), (2, 2)]


def test_removal_spans(spark):
    words = PASSAGE.split()
    at = words.index("northern")
    lines = page("Before it all. " + " ".join(words[:6]), ("TO LET, six rooms", "advert", 0), " ".join(words[6:at]) + " nor-", " ".join(["thern", *words[at + 1 :]]) + ", after", "The end of this.")
    tail = " ".join(words[8:])
    rows = [(f"x {PASSAGE}. {PASSAGE}! And y", None), lines, ("nothing here", None)]
    frame = spark.createDataFrame([(1, "s", "en", PASSAGE, None), (2, "s", "en", f"{tail} however", None)], ITEMS)
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in leaks.removal_spans(docs(spark, *rows), frame).collect())
    assert [rows[0][0][a:b] for d, a, b in got if d == 0] == [f"{PASSAGE}. {PASSAGE}!"]  # with the signs at and between words
    runs = {(r.doc_id, r.item_id): [(s.start, s.stop) for s in r.spans] for r in leaks.leaked_runs(docs(spark, *rows), frame).collect()}
    assert [rows[0][0][a:b] for a, b in runs[0, 2]] == [f"{tail}.", f"{tail}!"]
    assert not any(d == 2 for d, _, _ in got)
    text = rows[1][0]
    assert [text[a:b] for d, a, b in got if d == 1] == [" ".join(words[:6]), f"{' '.join(words[6:at])} nor-\nthern {' '.join(words[at + 1 :])},"]


def test_leaks_by_characters(spark):
    random.seed(10)
    letters = [chr(0x4E00 + random.randint(0, 3000)) for _ in range(150)]
    text = "".join(letters)
    misread = text[:40] + "口" + text[41:]
    frame = spark.createDataFrame([(1, "s", "zh", text, None)], ITEMS)
    rows = ["。".join([text[10:45], text[45:90]]), misread[20:85], text[:59], text[60:90] + text[:30]]
    got = leaks.leaks(docs(spark, *((t, None) for t in rows)), frame)
    assert sorted(r.doc_id for r in got.collect()) == [0, 1]


def test_items_in_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 100)
    other = " ".join(f"w{i}" for i in range(30))
    assert leaked(spark, [PASSAGE, PASSAGE, other], [PASSAGE, other]) == [(0, 0), (1, 0), (2, 1)]
