"""Token alignment against brute force over offsets and all link pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from inkgrove.llm import alignment
from inkgrove.llm.common import bound_batches, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_a string, pairs string, note string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts, tokenizers):
    """Per text: counts, groups, links; found from the sets of ends, with every pair listed."""
    a, b = tokenizers
    alphabet = alignment.byte_alphabet()
    rows, held = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) if i < 50256 else a.id_to_token(i).encode() for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(([], [], []))
            continue
        ends_a, ends_b = (list(np.cumsum(list(map(len, x)))) for x in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            for i, k in zip(ids, np.searchsorted(np.array(cuts), np.array(ends)).tolist()):
                groups[k][side].append(i)
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        held.update(set(links))
        rows.append((ids_a, ids_b, (groups, links)))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    found = []
    for ids_a, ids_b, more in rows:
        groups, links = more or ([], [])
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        found.append((len(ids_a), len(ids_b), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), digest))
    return found


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def compare(spark, texts, tokenizers, **options):
    rows = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = alignment.link_counts(rows, **options)
    assert got.columns == ["doc_id", "note", *COLUMNS]
    by = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    want = brute(texts, tokenizers)
    for i, expected in enumerate(want):
        assert by[i] == expected, (i, texts[i] and texts[i][:60])


AWKWARD = [
    None, "", " ", "\n\n", "  two  blanks ", "▁mark", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café — 漢字🙂 emoji",
    "tab\tand\rreturn\x00nul", "a", "same text", "same text", "ABC def", "=" * 300, "x" * 5000, " " * 700, "🙂" * 200, " 　wide",
]


def test_awkward_texts(spark, tokenizers):
    bound_batches(spark)
    compare(spark, AWKWARD, tokenizers)


@pytest.mark.parametrize("frequent", [0, 50, 1 << 18])
def test_frequent_and_rare_pairs(spark, tokenizers, frequent):
    """The same rows, however many pairs the broadcast table holds."""
    rng = random.Random(frequent)
    words = ["the", "of", "tion", "straße", "mañana", "über", "don't", "12,345", "http://x.y/z?q=1", "\n", "  "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    compare(spark, texts + AWKWARD, tokenizers, frequent=frequent)


def test_units_are_remembered_and_forgotten(spark, tokenizers, monkeypatch):
    """Texts are the same whether their words are new, known or forgotten, and wherever they meet."""
    units = alignment.Units(alignment.load("byte_bpe_50k.json"), alignment.load("piece_bpe_32k.model"))
    assert units.by_blanks
    rng = random.Random(2)
    words = ["the", "It's", "3.5", "x▁y", "a\nb", "naïve", "🙂", "'s", "...", "\u00a0n", "tab\t", "z" * 300, "\x1c", ".", "", "\u2028l"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    want = brute(texts, tokenizers)
    for remembered, joined in ((1 << 22, 1 << 12), (50, 30), (0, 1)):
        monkeypatch.setattr(alignment, "REMEMBERED", remembered)
        monkeypatch.setattr(alignment, "JOINED", joined)
        units.forget()
        for at in range(0, len(texts), 40):
            counts, written, borders, _, times = units.put_together(texts[at : at + 40])
            total = np.concatenate([[0], np.cumsum(times)])[borders]
            for k, expected in enumerate(want[at : at + 40]):
                digest = hashlib.sha256(written[k].encode()).hexdigest() if written[k] else ""
                assert (*counts[k], total[k + 1] - total[k], digest) == (*expected[:4], expected[6]), texts[at + k]


def test_documents_of_the_smallest_tables(spark, tokenizers):
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").select("text").collect()]
    compare(spark, texts, tokenizers)


def test_coalesce_against_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        ends = [np.unique(np.append(rng.integers(1, 40, rng.integers(1, 25)), 40)) for _ in range(2)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        second = np.repeat([0, 1], [len(e) for e in ends])
        order, group = alignment.coalesce(np.concatenate(starts), np.concatenate(ends), second)
        cuts = np.intersect1d(*ends)
        want = np.searchsorted(cuts, np.concatenate(ends))
        assert (group == want[order]).all()
        assert (np.lexsort((np.concatenate(starts), second, want)) == order).all()


def test_large_groups_count_distinct_pairs():
    n = 3000
    ids = np.concatenate([np.arange(n) % 7, np.arange(n) % 5])
    second = np.arange(2 * n) >= n
    aligned = alignment.Aligned(np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), second, ids, 1)
    _, pairs, times = alignment.links(aligned, 10, 100)
    assert len(pairs) == 35 and times.sum() == n * n
    assert dict(zip(pairs.tolist(), times.tolist()))[6 * 10 + 4] == (np.arange(n) % 7 == 6).sum() * (np.arange(n) % 5 == 4).sum()


def test_quick_encoder_equals_the_library():
    a = alignment.load("byte_bpe_50k.json")
    assert a.quick
    rng = random.Random(1)
    chars = "ab Z'é漢🙂\n\t  .,!0123456789don'tt've<|endoftext|> ́"
    for _ in range(500):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(200)))
        assert a.quick(text) == a.library.encode(text, add_special_tokens=False).ids
    assert len(a.encode(" " * (alignment.SPLITTER + 5))) > 0


def test_groups_as_text(spark):
    rows = spark.createDataFrame([(1, "straße", "x", "y", "z")], SCHEMA)
    got = alignment.align_tokens(rows).first()
    ids = [g.split("|") for g in got.groups.split(";")]
    assert sum(len(x.split(",")) for x, _ in ids) == got.n_a and sum(len(y.split(",")) for _, y in ids) == got.n_b
    assert len(ids) == got.n_groups and got.n_links == sum(got.times)


def test_empty_table(spark):
    assert alignment.link_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_are_documents(spark):
    rows = spark.createDataFrame([(1, "one text", "", "", "")] * 3 + [(None, "one text", "", "", "")], SCHEMA)
    got = alignment.link_counts(rows).collect()
    assert len(got) == 4 and all(r.count_sum == 4 * r.n_links for r in got)
