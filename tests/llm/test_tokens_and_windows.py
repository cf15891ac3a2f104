import random
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sourceloom.llm.packing import best_two_fit, fill_windows
from sourceloom.llm.tokenization import TokenAutomaton, automaton, token_counts, token_ids

PATH = "/opt/tokenizers/byte_bpe_50k.json"


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


AUTO = TokenAutomaton(Path(PATH).read_bytes())
REFERENCE = reference()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(text):
    assert AUTO.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids
    assert AUTO.decode(AUTO.encode(text)) == text


def test_hard_texts():
    for text in ("a" * 3000, " " * 2000, "ab" * 900, "<|endoftext|>", "x\r\n\t y", "中文" * 300, "éé\u0301😀", "'ll 're's"):
        assert AUTO.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids and AUTO.decode(AUTO.encode(text)) == text
    assert AUTO.encode("") == AUTO.encode(None) == [] and automaton(Path(PATH).read_bytes()) is automaton(Path(PATH).read_bytes())


def test_token_table(spark, tokenizer):
    rows = [(1, "hello world", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in token_ids(df, tokenizer=tokenizer).collect())
    assert got == [(0, [64]), (1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert sorted(r["n_tokens"] for r in token_counts(df).collect()) == [0, 0, 0, 1, 2]
    assert token_ids(df.limit(0)).count() == 0


def test_best_two_fit():
    rng = random.Random(2)
    for capacity in (10, 100, 512):
        sizes = [min(capacity, int(rng.lognormvariate(3, 1)) + 1) for _ in range(2000)]
        windows = best_two_fit(sizes, capacity)
        assert sorted(s for w in windows for s in w) == sorted(sizes) and all(sum(w) <= capacity for w in windows)
        assert len(windows) <= sum(sizes) / capacity * 1.02 + 2
    assert best_two_fit([], 5) == []
    # 6+3 leaves 1; its 3 is replaced by 2+2
    assert sorted(map(sorted, best_two_fit([6, 3, 2, 2], 10))) == [[2, 2, 6], [3]]


def test_windows(spark):
    docs = [(k, "word " * (k % 40)) for k in range(200)] + [(500, "long text " * 300), (501, None), (502, ""), (501, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS window_id", "2 AS n_tokens")
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    for shard in (20_000, 50):
        rows = fill_windows(df, capacity=128, shard_docs=shard).collect()
        used, per_doc = {}, {}
        for r in rows:
            used[r["window_id"]] = used.get(r["window_id"], 0) + r["n_tokens"]
            per_doc.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        assert max(used.values()) <= 128 and len([r for r in rows if r["doc_id"] == 501]) == 2
        for d, pieces in per_doc.items():
            assert d in (501, 502) or sum(n for _, _, n in pieces) == counts[d]
            assert counts[d] <= 128 and len(pieces) == (2 if d == 501 else 1) or sorted(pieces)[1][1] == 128
    assert fill_windows(df.limit(0)).count() == 0
    assert sorted(map(tuple, fill_windows(df, capacity=128).collect())) == sorted(map(tuple, fill_windows(df.repartition(7), capacity=128).collect()))
