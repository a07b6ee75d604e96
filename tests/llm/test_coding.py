"""Range coding, token files and pieces: exact round trips, and the libraries' own ids."""

import pickle
import random
import zlib

import corpus
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tidegauge import session
from tidegauge.llm import pieces, rans, token_files

END = 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=3000), st.integers(1, 5))
def test_blocks_come_back(ids, repeat):
    ids = np.array(ids * repeat, np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=701))
    assert len(ids) == 0 or int(table.frequencies.sum()) == 1 << table.scale
    coder = rans.Coder(table)
    data = rans.write_block(coder, 9, [4, None], [len(ids), 0], ids)
    block = rans.read_block(data, table)
    assert (block.first, block.doc_ids, block.counts.tolist()) == (9, [4, None], [len(ids), 0])
    assert block.ids(coder).tolist() == ids.tolist()


def test_parts_decode_by_themselves_and_damage_shows():
    ids = np.random.default_rng(0).integers(0, 50, 200_000).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=60))
    coder = rans.Coder(table)
    data = rans.write_block(coder, 0, [1], [len(ids)], ids)
    block = rans.read_block(data, table)
    assert block.parts == 4
    size = rans.LANES * rans.CHECKPOINT_STEPS
    for k in reversed(range(block.parts)):
        assert (block.part(coder, k) == ids[k * size:(k + 1) * size]).all()
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.read_block(bytes(bad), table)
    with pytest.raises(ValueError):
        rans.read_block(data, rans.Table.of_counts(np.ones(60, np.int64)))
    with pytest.raises(ValueError):
        coder.encode(np.array([55]))


def texts():
    rng = random.Random(1)
    letters = "abcdeéñ ▁\n\t\r\x1c\x85  ,.=-#/ 12表 \U0001f600 \xa0éİß'<|"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    return made + ["  a  b", "", " ", "x" * 500, "----" * 40, "a<|endoftext|>b", "don't", "     " * 9,
                   "internationalization" * 5, corpus.CLEAN]


def test_files_hold_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(3 * i, t) for i, t in enumerate(texts())]
    folder = session.scratch(spark, "test-files")
    token_files.write(spark.createDataFrame(rows[::-1], "doc_id long, text string"), folder, path, END)
    got = {r.doc_id: r for r in token_files.read(spark, folder, with_ids=True).collect()}
    start = 0
    for doc_id, text in rows:
        want = tokenizer.encode(text, add_special_tokens=False).ids + [END]
        row = got[doc_id]
        assert list(row.ids) == want, text
        assert (row.start, row.n_tokens) == (start, len(want))
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_the_library_s(spark, model):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pieces.decode(pieces.encode(docs, model), model).collect()
    got = {r.doc_id: (list(r.ids), r.text) for r in out}
    for doc_id, text in rows:
        want = processor.encode(text)
        assert got[doc_id][0] == want, text
        assert got[doc_id][1] == text.replace("▁", " ")
        assert got[doc_id][1] == processor.decode(want)
    digest = pieces.encode(docs, model, digest=True).collect()
    assert all(r.decodes and r.n_pieces == len(got[r.doc_id][0]) for r in digest)


def test_heap_gives_what_the_fold_gives(spark, model):
    units = sorted({u for t in texts() for u in pieces.units_of(t) if 2 <= len(u) <= pieces.LONGEST})
    frame = spark.createDataFrame([(u,) for u in units], "unit string")
    for row in pieces.cuts(frame, [], model).collect():
        assert pieces.cut_pieces(row.unit, row.cuts) == pieces.heap_pieces(row.unit, model)


def test_unigram_fold_is_the_best_path(spark):
    rng = random.Random(5)
    names = ["a", "b", "ab", "ba", "aba", "bb", "aab", "abab"]
    scores = [rng.uniform(-9, -1) for _ in names]
    unigram = pieces.Model(names, scores, [], 0, False, {p: i for i, p in enumerate(names)})
    units = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(60)})
    frame = spark.createDataFrame([(u,) for u in units], "unit string")
    got = {r.unit: pieces.cut_pieces(r.unit, r.cuts) for r in pieces.cuts(frame, [], unigram).collect()}
    worst = min(scores) - 10.0

    def value(parts):
        return sum(unigram.scores[unigram.ids[p]] if p in unigram.ids else worst for p in parts)

    def ways(unit):
        if not unit:
            yield []
        for n in range(1, len(unit) + 1):
            if n == 1 or unit[:n] in unigram.ids:
                for rest in ways(unit[n:]):
                    yield [unit[:n], *rest]

    for unit, parts in got.items():
        assert value(parts) == pytest.approx(max(map(value, ways(unit))))
        assert value(pieces.heap_pieces(unit, unigram)) == pytest.approx(value(parts))


def test_stored_units_change_no_ids(spark, model, monkeypatch):
    """Units with ids from the store and units from their bucket's lattice, against no store."""
    rows = [(i, t) for i, t in enumerate(texts() * 3)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, pieces.encode(docs, model, digest=True).collect()), key=str)
    asked = []
    counted = pieces.frequent_units
    monkeypatch.setattr(pieces, "STORE_BUCKETS", 4)
    monkeypatch.setattr(pieces, "frequent_units", lambda *a: asked.append(counted(*a)) or asked[-1])
    monkeypatch.setattr(pieces, "STORE_UNITS", 10)
    assert sorted(map(tuple, pieces.encode(docs, model, digest=True).collect()), key=str) == plain
    assert len(asked) == 1 and len(asked[0]) == 10
    for unit, ids in asked[0].items():
        wanted = [i for p in pieces.heap_pieces(unit, model) for i in model.piece_ids(p)]
        assert pieces.np.frombuffer(ids, "<i4").tolist() == wanted


def test_ids_of_many_units_are_those_of_each(model):
    """Cuts at random, also between characters that have no id."""
    rng = random.Random(8)
    units = sorted({"".join(rng.choice("▁aerß中💡\n") for _ in range(rng.randint(1, 60)))
                    for _ in range(300)})
    masks = [1 | rng.getrandbits(len(u) + 1) | 1 << len(u) for u in units]
    lacking = {u for u, m in zip(units, masks) if any(p not in model.ids for p in pieces.cut_pieces(u, m))}
    found, unsure = pieces.ids_of_units(units, np.array(masks), model)
    assert unsure == lacking and 0 < len(unsure) < len(units)
    assert found == {u: pieces.unit_ids(u, m, model) for u, m in zip(units, masks)}
    assert all(pieces.gives_back(u, found[u], model) for u in units if u not in unsure)
    assert pieces.ids_of_units([], np.array([], "i8"), model) == ({}, set())


def test_the_store_passes_the_driver_once_and_not_as_rows(spark, model, monkeypatch):
    frame = spark.createDataFrame([(t,) for t in texts() * 2], "text string")
    collect, rows = type(frame).collect, []
    monkeypatch.setattr(type(frame), "collect", lambda df: rows.append(collect(df)) or rows[-1])
    store = pieces.frequent_units(frame, model, 200)
    assert len(store) > 50
    assert max(map(len, rows), default=0) < len(store) // 2
    assert dict(pickle.loads(pickle.dumps(store))) == dict(store)
    for unit, ids in store.items():
        assert ids == pieces.unit_ids(unit, None, model) if len(unit) < 2 else np.frombuffer(
            ids, "<i4").tolist() == [i for p in pieces.heap_pieces(unit, model) for i in model.piece_ids(p)]
        assert (unit in store.odd) == (not pieces.gives_back(unit, ids, model))


@given(st.text(st.sampled_from(" ▁a.Z9\x00\r\n中"), max_size=30))
def test_stretches_hold_the_texts_units(text):
    marked = "▁" + text.replace(" ", "▁") if text else ""
    stretches = ["▁" + r for r in pieces.rests_of(text)]
    assert "".join(stretches) == marked
    assert all(s.startswith("▁") and "▁" not in s.lstrip("▁") for s in stretches)
    units = [u for s in stretches for u in pieces._UNITS.findall(s)]
    assert units == pieces.units_of(text)
    assert set(pieces.units_in(stretches)) | {"\x00"} == {*units, "\x00"}
    assert all(pieces._UNITS.findall(u) == [u] for u in units)


def test_edges_are_folded_in_parts(spark, model, monkeypatch):
    units = sorted({u for t in texts() for u in pieces.units_of(t) if 2 <= len(u) <= pieces.LONGEST})
    frame = pieces.unfolded(spark.createDataFrame([(u,) for u in units], "unit string"), [], model).toPandas()
    fold, sizes = pieces.merged_masks, []
    monkeypatch.setattr(pieces, "merged_masks", lambda *a: sizes.append(len(a[0])) or fold(*a))
    whole = pieces.ids_found(frame["unit"], frame["found"], model)
    monkeypatch.setattr(pieces, "UNITS_AT_ONCE", 7)
    sizes.clear()
    assert pieces.ids_found(frame["unit"], frame["found"], model) == whole
    assert max(sizes) == 7 and sum(sizes) == len(whole[0]) == len(frame) > 14
    assert all(ids == pieces.unit_ids(u, None, model) if len(u) > pieces.LONGEST else
               list(np.frombuffer(ids, "<i4")) == [i for p in pieces.heap_pieces(u, model) for i in model.piece_ids(p)]
               for u, ids in whole[0].items())
    assert pieces.ids_found(frame["unit"][:0], frame["found"][:0], model) == ({}, set())


def test_every_text_is_decoded(spark):
    """A piece whose id stands for another text: only the ids of the whole text show it."""
    names = ["?", "▁", "a", "b", "xy"]
    model = pieces.Model(names, [-9.0, -2.0, -2.0, -2.0, -1.0], [], 0, False, {"▁": 1, "a": 2, "b": 3, "ab": 4})
    rows = [(1, "ab"), (2, "a b"), (3, "b ab"), (4, ""), (5, None), (6, "ba")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_pieces, r.decodes) for r in pieces.encode(docs, model, digest=True).collect()}
    assert got == {1: (2, False), 2: (4, True), 3: (4, False), 4: (0, True), 5: (0, True), 6: (3, True)}


def test_arrays_of_ids_decode_like_lists(model):
    for text in texts():
        ids = [i for u in pieces.units_of(text) for p in pieces.heap_pieces(u, model) for i in model.piece_ids(p)]
        assert model.decoded(np.array(ids, "<i4")) == model.text(ids)
