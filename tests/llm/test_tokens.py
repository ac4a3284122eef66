import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import tokenizer as K
from tablewright.llm.packing import best_fit, pack_items
from tablewright.llm.splitting import split_documents

FOLDER = os.environ.get(K.TOKENIZER_DIR, K.DEFAULT_DIR)
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.json"), reason="no vocabulary here")
DOCS = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def vocabulary():
    return K.default_vocabulary()


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = [None, "", " ", "\n\n \t", "Hello world", "a" * 5000, "<|endoftext|> plain", "I'LL don't   stop\r\n\r\nnow ", "é́ 中文 \U0001f469‍\U0001f469‍\U0001f467 ٣٤ ½", "x\x00\x85  　y", "word " * 3000, "ab" * 2000 + "€" * 500, "Hello world"]


def test_same_ids_as_the_public_tokenizer(vocabulary, public):
    assert vocabulary.encode_batch(TEXTS) == [public(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(vocabulary, public, text):
    got = vocabulary.encode_batch([text])[0]
    assert got == public(text) and b"".join(vocabulary.tokens[i] for i in got).decode() == text


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    h = vocabulary.hash
    assert sorted(h.ids.tolist()) == list(range(len(vocabulary.tokens)))
    assert h.find(vocabulary.tokens).tolist() == list(range(len(vocabulary.tokens)))
    absent = [b" zzzqqq%d" % i for i in range(5000)]
    assert not any(vocabulary.tokens[i] == a for a, i in zip(absent, h.find(absent)) if i >= 0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_perfect_hash_of_few_keys(n):
    keys = [b"k%d" % i for i in range(n)]
    assert K.PerfectHash.build(keys).find(keys).tolist() == list(range(n))


def test_batches_of_any_slice_agree(vocabulary, monkeypatch):
    whole = vocabulary.encode_batch(TEXTS)
    monkeypatch.setattr(K, "SLICE_CHARS", 10)
    assert vocabulary.encode_batch(TEXTS) == whole


def test_documents(spark, vocabulary, public):
    df = spark.createDataFrame([(i % 10, t, "clash") for i, t in enumerate(TEXTS)], DOCS)
    got = sorted((r.doc_id, list(r.ids)) for r in K.encode_documents(df, "doc_id", "text", vocabulary).collect())
    assert got == sorted((i % 10, public(t)) for i, t in enumerate(TEXTS))
    counts = sorted((r.doc_id, r.n_tokens) for r in K.count_tokens(df, "doc_id", "text", vocabulary).collect())
    assert counts == sorted((i % 10, len(public(t))) for i, t in enumerate(TEXTS))
    assert K.encode_documents(df.where("false"), "doc_id", "text", vocabulary).count() == 0


# containers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_holds_all_within_capacity(sizes):
    bins = best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    # no two bins could be one
    fills = sorted(sum(sizes[i] for i in b) for b in bins)
    assert len(fills) < 2 or fills[0] + fills[1] > 50


def test_pack_items(spark):
    sizes = [None, 0, -3, 1, 99, 100, 101, 250, 300, 50, 50, 50, 50, 7, 7, 7]
    rows = [(i, s, "x", "x") for i, s in enumerate(sizes)] + [(3, 1, "x", "x")]
    df = spark.createDataFrame(rows, "id long, n int, container string, piece string").repartition(5)
    got = pack_items(df, "id", "n", 100).collect()
    total = {}
    for r in got:
        total[r.id] = total.get(r.id, 0) + r["size"]
    assert total == {i: max(s or 0, 0) for i, s in enumerate(sizes)} | {3: 2}
    assert sorted((r.piece, r["size"]) for r in got if r.id == 7) == [(0, 100), (1, 100), (2, 50)]
    assert [r.piece for r in got if r.id in (4, 5)] == [0, 0]
    fills = {}
    for r in got:
        if r.container is None:
            assert r["size"] == 0
        else:
            fills.setdefault(r.container, []).append(r)
    assert all(sum(r["size"] for r in f) == f[0].fill <= 100 for f in fills.values())
    assert len(fills) <= 1 + -(-sum(total.values()) // 100)


def test_pack_null_keys_hot_sizes_and_nothing(spark):
    df = spark.createDataFrame([(None, 60)] * 40 + [(1, 40)] * 40, "id long, n int").repartition(7)
    got = pack_items(df, "id", "n", 100).collect()
    assert len(got) == 80 and sum(r.id is None for r in got) == 40 and len({r.container for r in got}) <= 44
    assert pack_items(df.where("false"), "id", "n", 100).count() == 0


def test_little_room_is_left(spark, sf):
    from tablewright.llm import queries as Q

    got = Q.p8_containers(spark, sf).toPandas()
    fills = got.dropna(subset=["container"]).groupby("container")["size"].sum()
    assert fills.max() <= 4096 and len(fills) <= -(-got["size"].sum() // 4096) + 1


# pieces


def pieces(spark, vocabulary, text, limit=32, overlap=4):
    df = spark.createDataFrame([(1, text, "clash")], DOCS)
    rows = sorted(split_documents(df, "doc_id", "text", vocabulary, limit, overlap).collect(), key=lambda r: r.piece)
    if rows:
        ids = vocabulary.encode_batch([text])[0]
        assert rows[0].start_token == 0 and rows[-1].end_token == len(ids) == rows[0].doc_tokens
        for a, b in zip(rows, rows[1:]):
            assert overlap <= a.end_token - b.start_token <= overlap + 3 and a.end_token < b.end_token
        for r in rows:
            assert r.n_tokens <= limit and text[r.start_char : r.end_char] == r.text
            assert b"".join(vocabulary.tokens[i] for i in ids[r.start_token : r.end_token]).decode() == r.text
    return rows


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "\n\n", "\r\n", ". ", "Ende. ", "\U0001f600", "中文字", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é́", "<br>", "-- \n"]), min_size=5, max_size=120))
def test_pieces_cover_any_text(spark, vocabulary, parts):
    pieces(spark, vocabulary, "".join(parts))


def test_strong_breaks_come_first(spark, vocabulary):
    line = "one two three four five six seven."
    text = (line + " " + line + "\n" + line + "\n\n" + line + " ") * 6
    rows = pieces(spark, vocabulary, text, 64, 4)
    assert all(r.text.endswith("\n\n") for r in rows[:-1])
    assert all(r.text.endswith(".") for r in pieces(spark, vocabulary, (line + " ") * 30, 64, 4)[:-1])
    words = pieces(spark, vocabulary, "one two three " * 60, 64, 4)
    assert all(text[r.end_char - 1 : r.end_char + 1] for r in words)


def test_texts_without_breaks_are_cut_between_characters(spark, vocabulary):
    assert len(pieces(spark, vocabulary, "\U0001f600中" * 60)) > 3
    assert len(pieces(spark, vocabulary, "a" * 2000)) > 3


def test_short_empty_and_null_texts_have_no_pieces(spark, vocabulary):
    df = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "short", ""), (4, "word " * 40, ""), (4, "word " * 40, "")], DOCS)
    rows = split_documents(df, "doc_id", "text", vocabulary, 32, 4).collect()
    assert {r.doc_id for r in rows} == {4} and sum(r.piece == 0 for r in rows) == 2
    assert split_documents(df.where("false"), "doc_id", "text", vocabulary, 32, 4).count() == 0
    with pytest.raises(ValueError):
        split_documents(df, "doc_id", "text", vocabulary, 32, 30)


def containers(rows):
    return len({r.container for r in rows})


@pytest.mark.parametrize("ordered", [True, False])
def test_rows_in_order_of_size_pack_as_well(spark, monkeypatch, ordered):
    """Pairs that fill a container between them, all large ones before all small ones or in turn."""
    from tablewright.llm import packing as P

    monkeypatch.setattr(P, "PART_ITEMS", 5_000)
    sizes = [3_000] * 10_000 + [1_096] * 10_000 if ordered else [3_000, 1_096] * 10_000
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n int").repartitionByRange(4, "id")
    got = pack_items(df, "id", "n", 4_096).collect()
    assert len(got) == 20_000 and 10_000 <= containers(got) <= 10_100


def test_items_that_hardly_fit_together_close_where_they_are(spark, monkeypatch):
    """With and without a limit of what travels on the number of containers is the same."""
    from tablewright.llm import packing as P

    rnd = __import__("random").Random(1)
    df = spark.createDataFrame([(i, rnd.randint(1_500, 2_699)) for i in range(12_000)], "id long, n int")
    monkeypatch.setattr(P, "PART_ITEMS", 3_000)
    made = {}
    for carry in (100, 5_000, 10**9):
        monkeypatch.setattr(P, "CARRY", carry)
        made[carry] = containers(pack_items(df, "id", "n", 4_096).collect())
    assert made[100] < 1.01 * made[10**9] and made[5_000] < 1.005 * made[10**9], made


def test_a_text_of_a_million_tokens(spark, vocabulary):
    text = "one two three four five six seven eight nine ten, and so on and on. " * 60_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(split_documents(df, "doc_id", "text", vocabulary, 1024, 64).collect(), key=lambda r: r.piece)
    assert rows[0].doc_tokens > 1_000_000 and len(rows) > 1_000 and rows[-1].end_char == len(text)
    assert all(text[r.start_char : r.end_char] == r.text for r in rows) and all(a.end_token - 67 <= b.start_token <= a.end_token - 64 for a, b in zip(rows, rows[1:]))
