"""Piece encoding and id files against the libraries and plain versions."""

import hashlib
import io
import subprocess
import sys
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veclens.llm import bitplane, pieces
from veclens.llm.chunks import ChunkEncoder
from veclens.llm.texts import flat

public_tokenizers = pytest.importorskip("public_tokenizers")

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(MODEL)


@pytest.fixture(scope="module")
def table():
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    normal = {}
    for i in range(processor.get_piece_size()):
        if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i)):
            normal[processor.id_to_piece(i).replace("▁", " ")] = (i, processor.get_score(i))
    return normal


def encode_by_hand(text: str, table) -> list[int]:
    """Plain Viterbi over characters; earlier starts win ties, unknown characters become bytes."""
    if not text:
        return []
    text = " " + text.replace("▁", " ")
    unknown = min(score for _, score in table.values()) - 10
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * len(text)
    for start in range(len(text)):
        for end in range(start + 1, min(start + 49, len(text) + 1)):
            found = table.get(text[start:end])
            if found is None and end > start + 1:
                continue
            number, score = found or (None, unknown)
            if best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, start, number)
    ids, at = [], len(text)
    while at:
        _, start, number = best[at]
        ids.append([number] if number is not None else [3 + b for b in text[start:at].encode()])
        at = start
    return [i for one in reversed(ids) for i in one]


def encode(model, texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    ids, ends = model.encode(data, offsets, ChunkEncoder(model.best_path))
    plain, spans = model.decode(ids, ends)
    return [
        (ids[ends[i] : ends[i + 1]].tolist(), plain[spans[i] : spans[i + 1]].tobytes()) for i in range(len(texts))
    ]


TEXTS = ["", "a", " ", "  x  y ", "a\nb\t\tc", "日本語 ゼ梦", "\U0001f642\U0001f642 x", "\x00\x01 7", "a▁b", "ﷺ " + "x" * 300, "été où"]


def test_pieces_equal_plain_viterbi(model, table, sf_dir):
    import pyarrow.parquet as pq

    texts = TEXTS + [t[:300] for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:80]]
    for text, (ids, plain) in zip(texts, encode(model, texts), strict=True):
        assert ids == encode_by_hand(text, table)
        assert plain.decode() == text.replace("▁", " ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_pieces_round_trip(model, table, texts):
    for text, (ids, plain) in zip(texts, encode(model, texts), strict=True):
        assert plain.decode() == text.replace("▁", " ")
        assert ids == encode_by_hand(text, table)


def test_double_array_finds_all_pieces():
    words = [(w.encode(), i) for i, w in enumerate(["a", "ab", "abc", "b", "bcd", "é", "\x00", "\xff"])]
    base, check, value = pieces.double_array(words)

    def find(word):
        state = 0
        for byte in word:
            to = base[state] + byte
            if check[to] != state:
                return -1
            state = to
        return value[state]

    assert all(find(word) == i for word, i in words)
    assert find(b"bc") == -1 and find(b"c") == -1


def test_encode_documents_on_awkward_rows(spark, table):
    got = pieces.encode_documents(brute.awkward(spark).where("doc_id < 18 OR doc_id IS NULL"), MODEL).collect()
    rows = [row for row in brute.awkward_rows() if row[0] is None or row[0] < 18]
    expected = []
    for row in rows:
        ids = encode_by_hand(row[1] or "", table)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        expected.append((row[0], len(ids), crc, hashlib.sha256((row[1] or "").encode()).hexdigest(), True, ids))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert pieces.encode_documents(brute.empty(spark), MODEL).count() == 0


def likelihood_by_hand(text: str, table) -> tuple[float, dict]:
    """Log likelihood of a text and expected counts of its pieces, over a list of all segmentations."""

    def ways(at):
        if at == len(text):
            yield []
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in table:
                yield from ([text[at:end], *rest] for rest in ways(end))

    scored = [(way, np.exp(sum(table[one][1] for one in way))) for way in ways(0)]
    total = sum(p for _, p in scored)
    counts = {}
    for way, p in scored:
        for one in way:
            counts[table[one][0]] = counts.get(table[one][0], 0) + p / total
    return np.log(total), counts


def test_expected_counts_equal_all_segmentations(model, table):
    rng = np.random.default_rng(2)
    scores = np.log(rng.dirichlet(np.ones(len(model.score))))
    known = {piece: (i, scores[i]) for piece, (i, _) in table.items()}
    words = [" the", " talking", "a", " repeated", " the"]
    counts, likelihood = model.with_scores(scores).expected_counts([w.encode() for w in words], np.array([3, 1, 2, 1, 1]))
    expected = np.zeros(len(scores))
    total = 0.0
    for word, times in zip(words, [3, 1, 2, 1, 1], strict=True):
        one, by_id = likelihood_by_hand(word, known)
        total += times * one
        for i, share in by_id.items():
            expected[i] += times * share
    assert np.allclose(counts / pieces.SHARE, expected, atol=1e-4) and np.isclose(likelihood, total)


def unbroken(n: int, seed: int = 3) -> str:
    """Letters of several scripts with nothing to cut at."""
    rng = np.random.default_rng(seed)
    parts = ["the", "ing", "ation", "e", "q", "xz", "é", "日本", "ゼ", "梦", "\U0001f642", "word", "ſ", "ة"]
    return "".join(rng.choice(parts, n))


def test_long_chunks_equal_plain_viterbi(model, table):
    """20 KB without a cut, in stretches; also where a long text stands between short ones."""
    text = unbroken(6000)
    assert len(text.encode()) > 2 * pieces.STRETCH
    texts = ["a b", text, "c", "x " + text[:5000] + " y"]
    for own, (ids, plain) in zip(texts, encode(model, texts), strict=True):
        assert ids == encode_by_hand(own, table)
        assert plain.decode() == own


@pytest.mark.parametrize("stretch", [1, 7, 64, 200])
def test_stretches_of_any_length_give_the_same(model, monkeypatch, stretch):
    words = [unbroken(n, n).encode() for n in (1, 2, 30, 120, 121)] + [b"e" * 400, "\U0001f642".encode() * 60]
    times = np.arange(1, len(words) + 1)
    scores = np.zeros(len(model.score))
    scores[model.usable()] = -8 - np.arange(len(model.usable())) % 5
    for own in (model, model.with_scores(scores)):
        ids, counts = own.best_path(words)
        expected, logs = own.expected_counts(words, times)
        with monkeypatch.context() as patch:
            patch.setattr(pieces, "STRETCH", stretch)
            again, counts_again = own.best_path(words)
            found, logs_again = own.expected_counts(words, times)
        assert (ids == again).all() and (counts == counts_again).all()
        assert np.abs(found - expected).max() <= times.sum() * 8 and logs_again == pytest.approx(logs)


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path[:0] = {path!r}
from test_tokens import MODEL, unbroken
from veclens.llm import pieces
model = pieces.PieceModel.load(MODEL)
model.best_path([unbroken(6000).encode()])
text = unbroken(1_000_000).encode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, counts = model.best_path([text])
plain, _ = model.decode(ids, np.array([0, len(ids)]))
assert plain.tobytes() == text.removeprefix(b" ")
found, _ = model.expected_counts([text[:300_000]], np.ones(1, np.int64))
print(len(text) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_memory_of_a_long_unbroken_text():
    out = subprocess.run([sys.executable, "-c", MEMORY.format(path=sys.path)], capture_output=True, text=True, check=True).stdout
    megabytes, grown = map(int, out.split())
    assert megabytes >= 2 and grown < 40 * megabytes + 60


def test_query_uses_log_scores_of_its_texts(spark, sf_dir, model, table):
    import veclens.llm as llm

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").limit(60).cache()
    chunks = [(bytes(row.chunk), row.n) for row in pieces.chunk_counts(docs, model).collect()]
    words, times = [c for c, _ in chunks], np.array([n for _, n in chunks])
    reached = []
    for rounds in range(1, 4):
        scores = pieces.unigram_scores(docs, MODEL, rounds=rounds)
        assert np.isclose(np.exp(scores[model.usable()]).sum(), 1)
        reached.append(model.with_scores(scores).expected_counts(words, times)[1])
    assert reached[0] < reached[1] < reached[2]
    rows = docs.select("doc_id", "text").collect()
    fitted = {piece: (i, scores[i]) for piece, (i, _) in table.items()}
    pieces.encode_documents(docs, MODEL).count()  # workers must not remember its ids
    got = {row.doc_id: row.ids for row in pieces.encode_documents(docs, MODEL, scores=scores).collect()}
    assert got == {row.doc_id: encode_by_hand(row.text or "", fitted) for row in rows}
    ranks = sum(row.n_tokens for row in pieces.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL).collect())
    assert sum(row.n_tokens for row in llm.QUERIES["op3_pieces"](spark, sf_dir).collect()) < ranks


# ---- id files


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 4096])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = bitplane.to_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32)
    assert (bitplane.from_planes(planes, n) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_and_ranges(kind):
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 900, 60)
    docs = [rng.integers(0, 60_000, n).astype(np.uint32) for n in lengths]
    out = io.BytesIO()
    writer = bitplane.PlaneWriter(out, kind, block=512)
    for first in range(0, 60, 7):
        part = docs[first : first + 7]
        writer.add(np.arange(first, first + len(part)), [len(d) for d in part], np.concatenate(part))
    writer.close()
    reader = bitplane.PlaneReader(io.BytesIO(out.getvalue()))
    assert reader.docs.tolist() == list(range(60)) and reader.lengths.tolist() == lengths.tolist()
    assert [data for _, data in reader.documents()] == [d.tobytes() for d in docs]
    every = np.concatenate(docs)
    for start, stop in [(0, 0), (0, 1), (500, 520), (511, 1025), (0, len(every)), (len(every) - 3, len(every))]:
        assert (reader.ids(start, stop) == every[start:stop]).all()


def files_by_hand(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    start, out = 0, []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
        out.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_id_files_of_awkward_rows(spark, tmp_path):
    files = bitplane.write_ids(brute.awkward(spark), str(tmp_path), BPE, kind="bit")
    got = [tuple(row) for row in bitplane.read_documents(files).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, files_by_hand(brute.awkward_rows())))
    none = bitplane.write_ids(brute.empty(spark), str(tmp_path), BPE)
    assert bitplane.read_documents(none).count() == 0


def test_id_files_of_the_table(spark, sf_dir):
    import veclens.llm as llm

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(row) for row in llm.QUERIES["op8_bitplane"](spark, sf_dir).collect()]
    assert sorted(got) == files_by_hand(rows)


SPACES = st.sampled_from([" ", "\n", "\t", "  ", " ", " ", "　", " \n "])
PARTS = st.one_of(SPACES, st.sampled_from(["ab", "é", "12", "'s", "!?", "日本", "\x1c", "<|endoftext|>"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=4))
def test_chunks_never_change_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    encoder = ChunkEncoder(bitplane.library_encoder(BPE))
    ((_, _, ids, lengths),) = list(bitplane.encode_rows(pa.array(texts), encoder, 2))[:1] or [(0, 0, [], [])]
    at = 0
    for text, n in zip(texts, lengths, strict=True):
        assert ids[at : at + n].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at += n


def test_encoder_forgets_when_full():
    calls = []

    def lengths(chunks):
        calls.append(len(chunks))
        return np.array([len(c) for c in chunks], np.int32), np.ones(len(chunks), np.int64)

    encoder = ChunkEncoder(lengths, limit=2)
    data = np.frombuffer(b"aabbbcaa", np.uint8)
    for _ in range(3):
        ids, counts = encoder(data, np.array([0, 2, 5, 6, 8]))
        assert ids.tolist() == [2, 3, 1, 2] and counts.tolist() == [1] * 4
    assert calls == [3, 3, 3]
