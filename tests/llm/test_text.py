import math

from sourceloom.llm.distinctive import term_scores
from sourceloom.llm.quality import Words, document_statistics, language_references, not_prose, text_statistics

WORDS = [("en", w) for w in "the of and to a in is that it for was on when but not which each this be by".split()] + [("de", w) for w in "der die das und in ist nicht wenn wird".split()] + [("zh", w) for w in ("的", "我们", "在", "如果")]
PROSE = "When the packer starts, it reads each file that was in the queue. This is not a list, but the order of the files is kept by the writer.\n\nIt would be a mistake to sort it again."
CODE = "import os\n\ndef f(x):\n    # the value of the thing\n    return {x: 1}\n\nclass A(B):\n    y: int = 0\n"
TABLE = "| a | b |\n|---|---|\n| 1 | the |\n| 2 | x |\n"


def share(text):
    return text_statistics(text, Words(WORDS))["sentence_share"]


def test_sentence_share():
    assert share(PROSE) > 0.95 and share(PROSE.lower().replace(".", "").replace(",", "")) > 0.95
    assert share("When the packer starts, it reads\neach file that was in the queue and\nwrites it.") > 0.9
    assert share("Wenn der Speicher voll ist, wird die Datei nicht gelesen.") > 0.9 and share("如果我们在这里找到的文件，就会停止。") > 0.9
    for text in (CODE, TABLE, "- alpha\n- beta\n- gamma\n", "2025-04-19T02:51:33Z level=warn comp=x took=2\n" * 3, "key: value\nother: 3\n", "OyRJnjXHAiLXNncEdnw4yEn345lmP3HH7S6oPsbG\n" * 4, "GET,/a/{id},b\nx,1,2\n", "  at Pallet.migrate (registry.js:795:69)\n" * 3):
        assert share(text) < 0.5, text


def test_statistics_and_tails(spark):
    docs = [(k, PROSE.replace("packer", f"packer {k}"), "EN-us", 1.0) for k in range(40)] + [(100, CODE, "en", 1.0), (101, TABLE, None, 1.0), (102, None, "en", 1.0), (103, " \n\t", "en", 1.0), (104, "", "de", 1.0), (105, PROSE * 200, "en", 1.0), (105, PROSE * 200, "en", 1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, sentence_share double")
    words = spark.createDataFrame(WORDS, "lang string, word string")
    stats = {r["doc_id"]: r for r in document_statistics(df, words).collect()}
    assert stats[0]["recorded"] == "en" and stats[0]["language"] == "en" and not stats[102]["has_text"] and stats[103]["n_words"] is None and stats[100]["n_lines"] == 9
    assert document_statistics(df, words).count() == len(docs)
    refs = {r["group"]: r for r in language_references(document_statistics(df, words)).collect()}
    assert refs["en"]["sentence_share_at"] > 0.95
    assert {r["doc_id"] for r in not_prose(df, words).collect()} == {100, 101}
    assert not_prose(df.limit(0), words).count() == 0 and not_prose(df, words.limit(0)).count() > 0


def test_term_scores(spark):
    rows = [(1, ["The", "the", "rare", "rare", None, " "], ["f"], "x"), (1, ["The", "the", "rare", "rare", None, " "], ["f"], "x"), (2, ["the"], None, "x"), (3, ["the", "b"], [], "x"), (4, None, None, "x")]
    df = spark.createDataFrame(rows, "chunk_id bigint, tokens array<string>, symbols array<string>, term string")
    got = {(r["chunk_id"], r["field"], r["term"]): r for r in term_scores(df).collect()}
    assert set(got) == {(1, "tokens", "the"), (1, "tokens", "rare"), (1, "symbols", "f"), (2, "tokens", "the"), (3, "tokens", "the"), (3, "tokens", "b")}
    r = got[(1, "tokens", "rare")]
    want = 2 * (-math.log2(1 / 4) + math.log2(1 - math.exp(-2 / 4)))
    assert (r["tf"], r["df"], r["cf"]) == (2, 1, 2) and abs(r["score"] - want) < 1e-9
    assert r["score"] > got[(1, "tokens", "the")]["score"]
    assert term_scores(df.limit(0)).count() == 0


def test_a_language_of_tables(spark):
    """The verdict on a text doesn't depend on the others of its language."""
    german = "Wenn der Speicher voll ist, wird die Datei nicht gelesen."
    docs = [(k, TABLE.replace("1", str(k)), "en") for k in range(90)] + [(k, PROSE, "en") for k in range(100, 110)] + [(k, f"- der Posten\n- die Zahl {k}\n- der Rest\n", "de") for k in range(200, 209)] + [(300, german, "de"), (400, "| 的 | 1 |\n|---|---|\n", "zh")]
    words = spark.createDataFrame(WORDS, "lang string, word string")
    got = not_prose(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), words)
    assert {r["doc_id"] for r in got.collect()} == {*range(90), *range(200, 209), 400} and "in_tail" in got.columns


def test_semicolons_in_prose_and_statements_of_words():
    assert share("On that day, there is no need to rank the shard twice;\nthe map remembers the result of it.") > 0.9
    assert share("This is the order of the files;\nit is kept by the writer.") > 0.9
    assert share('def f():\n    assert the_item is not None, f"the item is not found in {the_list!r}"\n    names = [x for x in the_list if x and x is not the_item]\n    log.debug("the item is not in the list: %s", x)\n') < 0.3
    assert share("int total = sum of the parts;\nreturn a or b or c;\nx = not a and that or this of it;\n") < 0.3


def test_junk_that_passes_as_sentences(spark):
    """Junk letters meet short common words by chance; the tails of their language tell."""
    junk = "a;sq qlfja a;lskdj fqwlk; a;dkfj s;lfkqj a;wdkl sqfd"
    few = "Please check that larger caches still survive when compaction ends, which happened yesterday."
    assert share(junk) > 0.9 and share(few) > 0.9
    german = "Wenn der Speicher voll ist, wird die Datei nicht gelesen."
    docs = [(k, f"When the packer {'starts' * (k % 3)} it reads each file that was in the queue of {'writer' * (k % 4)}.", "en") for k in range(40)]
    docs += [(k, TABLE.replace("1", str(k)), "en") for k in range(100, 300)] + [(400, junk, "en"), (401, few, "en"), (402, german, "de")]
    words = spark.createDataFrame(WORDS, "lang string, word string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in not_prose(df, words).collect()} == {*range(100, 300), 400}
    refs = {r["group"]: r for r in language_references(document_statistics(df, words)).collect()}
    assert refs["en"]["n"] == 42 and refs["en"]["sentence_share_at"] > 0.9
