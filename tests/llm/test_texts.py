import random
from collections import defaultdict

import numpy as np
import pytest

from varloom.llm.bpe import PATTERN, VOCABULARY, Encoder, encode_corpus, load, token_counts
from varloom.llm.packing import best_fit, pack_documents, pack_items, shared_containers
from varloom.llm.splitting import BLOCK, ITEM, KINDS, LINE, SUBITEM, WORD, Tree, describe, pieces, split_documents

TEXTS = ["", None, " ", "a", "hello world's  end\n\n\n x", "naïve 中文。日本語！", "‍  x", "<|endoftext|> ok", "a" * 5000, "ACGT" * 3000,
         "\n" * 500 + "x", "🙂👨‍👩‍👧" * 40, "1234567890" * 200, "\r\n\ttab", "the the the", "\x00\x01"]


def tiktoken_encoding():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return np.frombuffer(load().encode(text), np.int32).tolist()


def test_merges_equal_brute_force():
    def brute(ranks, piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng, ranks = random.Random(1), {bytes([c]): i for i, c in enumerate(b"abc")}
    pool = list(ranks)
    while len(ranks) < 300:  # also pairs whose parts come later: the queue must take lower ranks as they appear
        new = rng.choice(pool) + rng.choice(pool)
        if new not in ranks and len(new) < 9:
            ranks[new] = 3 + len(ranks) * 37 % 8000
            pool.append(new)
    enc = Encoder(ranks)
    for _ in range(1500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60)))
        assert enc.merge(piece) == brute(ranks, piece)
        assert not any(enc.low) and not any(enc.middle)


def test_ids_equal_other_implementation():
    enc, rng = tiktoken_encoding(), random.Random(3)
    for t in TEXTS:
        if t:
            assert ids(t) == enc.encode_ordinary(t), t[:50]
    alphabet = "abc dé中\n\t.,'sS09🙂"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80)))
        assert ids(t) == enc.encode_ordinary(t)


def test_corpus(spark):
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)] + [(0, "", [1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: list(r["ids"]) for r in encode_corpus(df).collect()}
    assert got[0] == [] and got[1] == [] and all(got[i] == ids(t) for i, t in enumerate(TEXTS) if t)
    sizes = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode_corpus(df, id_col="ids")


def test_best_fit_fills_and_separates_copies():
    rng = random.Random(4)
    sizes = [rng.randint(1, 400) for _ in range(2000)]
    clusters = [f"c{i % 900}" if i % 3 else None for i in range(2000)]
    for distinct in (False, True):
        bins = best_fit(sizes, clusters, [f"s{i % 4}" for i in range(2000)], 1000, distinct)
        filled = np.bincount(bins, weights=sizes)
        assert filled.max() <= 1000
    bins = best_fit(sizes, clusters, [None] * 2000, 1000)
    filled = np.bincount(bins, weights=sizes)
    assert filled.sum() / (1000 * len(filled)) > 0.98
    together = sum(len(b) - len(set(b)) for b in _by(bins, clusters).values())
    assert together <= 10
    one_text = best_fit([10] * 500, ["same"] * 500, [None] * 500, 100)
    assert len(set(one_text)) == 50


def _by(bins, clusters):
    out = defaultdict(list)
    for b, c in zip(bins, clusters):
        if c is not None:
            out[b].append(c)
    return out


@pytest.mark.parametrize("shard_items", [20000, 40])
def test_pack_items(spark, shard_items):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 77, 512, 700, 1500]), None if i % 5 else "dup", "s") for i in range(600)] + [(9999, None, None, None)]
    df = spark.createDataFrame(rows, "item_id bigint, size bigint, cluster string, source string")
    got = pack_items(df, {1: 512, 2: 100}, shard_items=shard_items).toPandas()
    for limit, capacity in ((1, 512), (2, 100)):
        own = got[got.limit_id == limit]
        assert own.groupby("item_id").n_tokens.sum().to_dict() == {i: s or 0 for i, s, _, _ in rows}
        filled = own[own.n_tokens > 0].groupby("container").n_tokens.sum()
        assert filled.max() <= capacity and own[own.n_tokens == 0].container.isna().all() and own[own.n_tokens > 0].container.notna().all()
        for i, s, _, _ in rows:
            if s and s <= capacity:
                assert (own.item_id == i).sum() == 1
        least = -(-sum(s or 0 for _, s, _, _ in rows) // capacity)
        assert len(filled) <= least * 1.12 + 1
    assert pack_items(df.limit(0), {1: 512}).count() == 0


def test_repeated_ids_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(7, 1500, "c", "s")] * 2 + [(7, 2000, None, None)] * 3, "item_id bigint, size bigint, cluster string, source string")
    got = pack_items(df, {1: 1000}).toPandas()
    filled = got.groupby("container").n_tokens.sum()
    assert filled.max() <= 1000 and filled.sum() == 9000 and len(filled) == 9


def test_items_that_cannot_be_combined_stay_in_their_shards(spark):
    df = spark.range(2000).selectExpr("id AS item_id", "600L AS size", "CAST(NULL AS string) AS cluster", "'s' AS source")
    got = pack_items(df, {1: 1000}, shard_items=50).toPandas()
    assert got.container.nunique() == 2000 and len({c.rsplit("-", 1)[0] for c in got.container}) == 40
    assert {c.split("-")[0] for c in got.container} == {"0"}


def test_rounds_save_containers_in_bounded_shards(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([330, 340, 510, 520, 150]), None, f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "item_id bigint, size bigint, cluster string, source string")
    small, one = (pack_items(df, {1: 1000}, shard_items=n, distinct_sources=False).toPandas() for n in (300, 3000))
    assert small.groupby("container").n_tokens.sum().max() <= 1000 and sorted(small.item_id) == list(range(3000))
    # equal items, a third of all in one text and one source: no walk over all containers, no more of them than needed
    assert small.container.nunique() <= one.container.nunique() * 1.03
    hot = best_fit([100] * 6000, ["same"] * 2000 + [None] * 4000, ["s"] * 3000 + [None] * 3000, 1000)
    assert len(set(hot)) == 600 and max(np.bincount(hot)) == 10


def test_sources_keep_apart_where_that_costs_nothing():
    rng = random.Random(9)
    sizes, sources = [rng.randint(50, 500) for _ in range(400)], [f"s{rng.randint(0, 40)}" for _ in range(400)]
    with_them, without = (best_fit(sizes, [None] * 400, sources, 1000, d) for d in (True, False))
    shared = [sum(len(b) - len(set(b)) for b in _by(x, sources).values()) for x in (with_them, without)]
    assert shared[0] < shared[1] and len(set(with_them)) <= len(set(without)) + 1


def test_shared_containers(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "c", None), (4, None, "x")], "doc_id bigint, text string, source string")
    packed = pack_documents(docs, {1: 100, 2: 2})
    got = {r["limit_id"]: (r["n_containers"], r["n_shared_copies"], r["n_shared_sources"]) for r in shared_containers(packed, docs).collect()}
    assert got == {1: (1, 1, 1), 2: (3, 0, 0)}


def test_pack_documents(spark):
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(TEXTS * 2)], "doc_id bigint, text string, source string, size string")
    got = pack_documents(df, {7: 64}).toPandas()
    assert set(got.doc_id) == set(range(2 * len(TEXTS)))
    assert (got.groupby("doc_id").n_tokens.sum() == [len(ids(t)) if t else 0 for t in TEXTS * 2]).all()


STRUCTURED = "== Head ==\n\n" + "\n\n".join("Para %d begins. It goes on! And on.\n* item one\n* item two" % i for i in range(60)) + "\n\n# Next\n\nlast words"


@pytest.mark.parametrize("text", [t for t in TEXTS if t] + [STRUCTURED, " " * 3000 + "x", "x" + "\n \n" * 700 + "y", "é" * 900 + ". " + "b " * 900])
@pytest.mark.parametrize("limit, overlap", [(256, 32), (16, 0), (20, 12), (64, 5)])
def test_pieces_tile_the_text(text, limit, overlap):
    enc = load()
    tokens = enc.findall(text)
    packed = np.array([describe(t, len(enc.merge(t.encode()))) for t in tokens], np.int64)
    total = len(ids(text))
    if total <= limit:
        return
    got = pieces(Tree(enc, tokens, packed), limit, overlap)
    end = chars = 0
    for k, (first, n, shared, begin, stop, kind) in enumerate(got):
        assert 0 < n <= limit
        assert shared == (min(overlap, end) if k else 0) and first == end - shared
        assert first + n > end and stop > chars and begin <= chars
        end, chars = first + n, stop
    assert end == total and chars == len(text)
    assert all(a[4] >= b[3] for a, b in zip(got, got[1:]))


def test_cuts_are_natural():
    enc = load()
    tokens = enc.findall(STRUCTURED)
    packed = np.array([describe(t, len(enc.merge(t.encode()))) for t in tokens], np.int64)
    kinds = {p[5] for p in pieces(Tree(enc, tokens, packed), 100, 10)}
    assert kinds <= {"section", "paragraph", "end"}
    for first, n, shared, begin, stop, kind in pieces(Tree(enc, tokens, packed), 20, 0):
        assert kind not in ("part", "token")
        if kind == "paragraph":
            assert STRUCTURED[:stop].endswith("\n\n")
    words = "word " * 500
    tokens = enc.findall(words)
    packed = np.array([describe(t, 1) for t in tokens], np.int64)
    assert {p[5] for p in pieces(Tree(enc, tokens, packed), 50, 0)} == {"word", "end"}


def tree_of(text):
    enc = load()
    tokens = enc.findall(text)
    return Tree(enc, tokens, np.array([describe(t, len(enc.merge(t.encode()))) for t in tokens], np.int64))


def level_before(text, what, nth=0):
    at = -1
    for _ in range(nth + 1):
        at = text.index(what, at + 1)
    tree = tree_of(text)
    return tree.levels[tree.chars.index(at)]


def test_structure_is_a_tree():
    text = ("# One\n\nlead\nsecond line\n\n## Two\n\n* a\n  - b\n\t- c\n* d\n\n### Three\nbody\n\n> said\n> more\nafter\n\n```\n# no heading\n\n* no item\n```\nend\n"
            "4. RESULTS\n\n1. first\n2. second\n>REC1 x\nACGT\n<table>\nrow\n-5 degrees\n#tag\n# Last\n")
    assert [level_before(text, h) for h in ("# One", "## Two", "### Three", "# Last")] == [0, 1, 2, 0]
    assert [level_before(text, x) for x in ("lead", " a", "body", " first")] == [WORD, WORD, WORD, WORD]  # headings and marks keep what follows
    assert level_before(text, "second line") == LINE and level_before(text, "* d") == ITEM
    assert level_before(text, " - b") == SUBITEM and level_before(text, "- c") == SUBITEM
    assert level_before(text, "> said") == BLOCK and level_before(text, "> more") == LINE and level_before(text, "after") == BLOCK
    assert level_before(text, "```") == BLOCK and level_before(text, "# no heading") == LINE and level_before(text, "* no item") == LINE
    assert level_before(text, "end\n") == BLOCK and level_before(text, "4. RESULTS") == 5 and level_before(text, "2. second") == ITEM
    assert level_before(text, ">REC1") == BLOCK and level_before(text, "<table>") == BLOCK
    assert level_before(text, "-5 degrees") == LINE and level_before(text, "#tag") == LINE
    assert KINDS[BLOCK] == "paragraph" and KINDS[5] == "section"


@pytest.mark.parametrize("line", ["\r\n", "\r", "\x85", "\u2028", "\n"])
def test_all_line_ends_count(line):
    text = f"# One{line}{line}lead{line}second line{line}{line}* a{line}* b{line}{line}# Two{line}x"
    got = [level_before(text, x) for x in ("lead", "second line", "* a", "* b", "# Two", "x")]
    assert got == [WORD, LINE, BLOCK, ITEM, 0, WORD]


def test_deeper_headings_give_way_to_higher_ones():
    part = "## Sub\n\n" + "word " * 30 + "\n\n"
    text = ("# Top\n\n" + part + part + part) * 4
    ends = [text[p[4] :] for p in pieces(tree_of(text), 120, 0)]
    assert all(e.startswith("# Top") or not e for e in ends)  # two thirds of the pieces could hold one more section


def test_no_piece_is_a_heading_and_pieces_are_well_filled(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = split_documents(docs, {1: (256, 32), 2: (512, 64)}).toPandas().sort_values(["limit_id", "doc_id", "piece_no"])
    before = got.groupby(["limit_id", "doc_id"]).end_char.shift(fill_value=0)
    new = [t[max(0, b - f) :] for t, b, f in zip(got.text, before, got.first_char)]
    alone = [len(x) < 200 and bool(re.fullmatch(r"\s*(#{1,6}|={1,6}) [^\n\r\x85\u2028\u2029\x0b\x0c]*\s*", x)) for x in new]
    assert not any(a and c != "end" for a, c in zip(alone, got["cut"]))
    assert not any(re.search(r"\n(#{1,6}|={1,6}) [^\n\r\x85\u2028\u2029\x0b\x0c]*\s*$", x) and c != "end" for x, c in zip(new, got["cut"]))
    inner = got[got["cut"] != "end"]
    assert (inner.n_tokens / inner.limit_id.map({1: 256, 2: 512})).groupby(inner.limit_id).mean().min() > 0.85


def test_only_the_piece_above_the_limit_is_cut_shorter():
    # overlaps that begin inside long pre-tokens take more tokens when encoded alone
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 400))) for _ in range(60))
    enc = load()
    for limit, overlap in ((64, 16), (32, 8)):
        got = pieces(tree_of(text), limit, overlap)
        assert all(len(enc.encode(text[b:e])) // 4 <= limit for _, _, _, b, e, _ in got)
        assert np.mean([n for _, n, *_ in got[:-1]]) > 0.8 * limit


def test_a_piece_that_cannot_keep_the_limit_is_an_error():
    tree = tree_of("word " * 300)
    tree.alone = lambda first, end: 10**6
    with pytest.raises(ValueError):
        pieces(tree, 100, 10)


def test_split_documents(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, STRUCTURED, STRUCTURED])], "doc_id bigint, text string, cut string")
    got = split_documents(df, {4: (64, 8), 5: (512, 0)}).toPandas()
    for (limit, doc), part in got.groupby(["limit_id", "doc_id"]):
        text = [*TEXTS, STRUCTURED, STRUCTURED][doc]
        part = part.sort_values("piece_no")
        assert list(part.piece_no) == list(range(1, len(part) + 1))
        assert all(text[a:b] == t for a, b, t in zip(part.first_char, part.end_char, part.text))
    over = {(l, i) for l, m in ((4, 64), (5, 512)) for i, t in enumerate([*TEXTS, STRUCTURED, STRUCTURED]) if t and len(ids(t)) > m}
    assert set(zip(got.limit_id, got.doc_id)) == over
    assert split_documents(df.limit(0), {4: (64, 8)}).count() == 0
    with pytest.raises(ValueError):
        split_documents(df, {1: (20, 20)})
