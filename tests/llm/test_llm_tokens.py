"""Token alignment, byte-pair trees and the conversation trie against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import tiktoken

from sessionlens.llm import alignment, bpe, catalog, turn_trie
from sessionlens.llm.vocabulary import BYTE_MODEL, PATTERN, PIECE_MODEL, RANKS, parse_ranks, read_bytes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "\n\n \t x", "it's 12,345 o'clock!!  <|endoftext|> <s> </s> <0x41>", "a▁b", "漢字かな交じり文 ü ß 🙂👍🏽",
    "é́ nul\x00 nbsp end ", "word " * 3000, "a" * 5000, "=-" * 700, "\r\n\r\n", "x" * 31 + " " * 37 + "y", " lead and trail ",
]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def ranks():
    return parse_ranks(read_bytes(RANKS))


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 7, 16])
def test_joined_halves_equal_the_direct_encoding(ranks, plain, leaf):
    rng = random.Random(leaf)
    tree = bpe.MergeTree(ranks, leaf)
    for _ in range(400):
        letters = rng.choice(["ab", "a", "abcdefghijklmnopqrstuvwxyz", "éàüß漢字かな", "!-=_*.#"])
        word = "".join(rng.choices(letters, k=rng.choice([1, 5, 30, 200, 700])))
        ids = tree.word(word)
        assert ids == plain.encode_ordinary(word)
        assert tree.decode(ids) == word.encode()


def test_join_is_associative_for_any_cut(ranks):
    rng = random.Random(5)
    tree = bpe.MergeTree(ranks)
    for _ in range(300):
        data = "".join(rng.choices("etaonhs ", k=40)).encode()
        cuts = sorted(rng.choices(range(41), k=2))
        a, b, c = (tree.merge(data[i:j]) for i, j in zip([0, *cuts], [*cuts, 40]))
        whole = tree.merge(data)
        assert tree.join(tree.join(a, b), c) == whole == tree.join(a, tree.join(b, c))


def test_merges_keep_to_the_ranks_of_any_vocabulary():
    # Tokens that no merge reaches, and ranks against the order of length.
    rng = random.Random(6)
    for _ in range(60):
        extra = {"".join(rng.choices("abc", k=rng.randrange(2, 6))).encode() for _ in range(12)}
        order = [bytes([b]) for b in range(256)] + rng.sample(sorted(extra), len(extra))
        ranks = {t: i for i, t in enumerate(order)}
        tree = bpe.MergeTree(ranks, 3)
        plain = tiktoken.Encoding("small", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(30):
            word = "".join(rng.choices("abc", k=rng.randrange(1, 40)))
            assert tree.word(word) == plain.encode_ordinary(word)


def expected_digests(plain, text):
    ids = plain.encode_ordinary(text or "")
    return len(ids), sha(" ".join(map(str, ids))), sha((text or "").encode())


def test_byte_pairs_query_equals_the_library(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op12_byte_pairs"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected_digests(plain, docs[r.doc_id])


def test_byte_pairs_on_odd_texts(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again")]
    got = bpe.token_digests(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(i, *expected_digests(plain, t)) for i, t in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert bpe.token_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_byte_pairs_keep_other_columns_and_round_trip(spark):
    rows = [(i, t, [i], "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string")
    encoded = bpe.encode_texts(docs)
    assert encoded.columns == ["doc_id", "text", "ids", "decoded", "_ids"]
    back = bpe.decode_ids(encoded, "_ids")
    assert back.columns == ["doc_id", "text", "ids", "decoded", "_decoded"]
    assert all(bytes(r._decoded) == (r.text or "").encode() for r in back.collect())
    both = bpe.encode_texts(docs, decoded="decoded")
    assert both.columns == ["doc_id", "text", "ids", "decoded", "_ids", "_decoded"]
    assert sorted(both.select("doc_id", "_decoded").collect()) == sorted(back.select("doc_id", "_decoded").collect())


def plain_alignment(texts):
    """Groups, links and counts by dictionaries, with both libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_str(read_bytes(BYTE_MODEL).decode())
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    symbols = alignment.byte_level_tokens(read_bytes(BYTE_MODEL))
    docs = []
    for text in texts:
        groups = []
        if text:
            wanted = (" " + text).encode()
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text, num_threads=1)
            raw_a = [symbols[i] for i in a]
            raw_b = [
                bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
                for i in b for p in [b_model.id_to_piece(i)]
            ]
            if b"".join(raw_a) == wanted == b"".join(raw_b):
                ends = [set(), set()]
                for side, raw in enumerate((raw_a, raw_b)):
                    at = 0
                    for token in raw:
                        at += len(token)
                        ends[side].add(at)
                cuts = sorted(ends[0] & ends[1])
                sides = []
                for ids, raw in ((a, raw_a), (b, raw_b)):
                    parts, at, k = [[] for _ in cuts], 0, 0
                    for i, token in zip(ids, raw):
                        at += len(token)
                        parts[k].append(i)
                        k += at == cuts[k]
                    sides.append(parts)
                groups = list(zip(*sides))
        docs.append(groups)
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for groups in docs]
    count = Counter(pair for doc in links for pair in doc)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups, pairs in zip(docs, links):
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((
            sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in pairs.items()), text,
        ))
    return out, count, links


def test_alignment_query_equals_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _, _ = plain_alignment([t for _, t in docs])
    want = {i: (*w[:6], sha(w[6]) if w[6] else "") for (i, _), w in zip(docs, want)}
    got = catalog.QUERIES["op11_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


@pytest.mark.parametrize("entries", [1, 3_000_000])
def test_alignment_on_odd_texts_in_blocks_of_any_size(spark, monkeypatch, entries):
    monkeypatch.setattr(alignment, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(alignment, "SLICE", 50)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again and again"), (3, "again and again")]
    want, count, links = plain_alignment([t for _, t in rows])
    docs = spark.createDataFrame(rows, SCHEMA + "").repartition(3)
    got = alignment.align_tokens(docs).collect()
    assert Counter(map(tuple, got)) == Counter((i, *w) for (i, _), w in zip(rows, want))
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(alignment.index_texts(docs)).collect()}
    assert pairs == {p: (n, sum(doc[p] for doc in links)) for p, n in count.items()}


def test_alignment_of_nothing_and_of_clashing_columns(spark):
    assert alignment.align_tokens(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([("x", 1, "some words", 2)], "block string, ord int, words string, plane int")
    row = alignment.align_tokens(docs, "block", "words").first()
    assert row.block == "x" and row.n_groups == 2


def test_bitmaps_hold_every_document_and_multiplicity():
    rng = random.Random(9)
    entries = {(rng.randrange(40), rng.randrange(1 << 16)): rng.choice([1, 1, 2, 3, 9, 1000]) for _ in range(5000)}
    keys = alignment.np.array([p * alignment.BLOCK_DOCS + d for p, d in entries], alignment.np.int64)
    counts = alignment.np.array(list(entries.values()), alignment.np.int64)
    by = keys.argsort()
    columns = alignment.bitmap_planes(keys[by], counts[by], 7)
    back = Counter()
    for a, b, plane, n, words in zip(*(columns[c].to_pylist() for c in ("a", "b", "plane", "n_docs", "words"))):
        docs = [
            (w >> 16) * 16 + bit
            for w in alignment.np.frombuffer(words, "<u4").tolist() for bit in range(16) if w >> bit & 1
        ]
        assert len(docs) == n
        for d in docs:
            back[a * 7 + b, d] += 1 if plane == 0 else 1 << (plane - 1)
    assert back == entries


def plain_trie(rows):
    """Nodes by a dictionary of prefixes; rows are (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    said = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: v[0])] for c, v in turns.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(said.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, ids in members.items():
        cost = (len(ids) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += cost
            leaves[path[:d]] += path not in children
    return Counter(
        (
            ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), children[path], leaves[path], saved[path],
            sha(",".join(str(c) for c in ids if len(rebuilt[c]) == len(path))),
        )
        for path, ids in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string"


def random_turns(rng, convs):
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        size = rng.choice([1, 1, 2, 3, 5, 8, 12, 70, 140]) if rng.random() < 0.3 else rng.randrange(1, 6)
        for t in range(size):
            hot = rng.random() < 0.6
            rows.append((c, t, rng.choice(["user", "assistant"]) if not hot else "user", "hi" if hot else rng.choice(["é", "", None, "ok", "漢字"])))
    # A third of the conversations are copies of one.
    for c in range(convs * 2, convs * 2 + convs // 2):
        rows += [(c, 0, "user", "hi"), (c, 1, "assistant", "hello"), (c, 2, "user", "bye")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_equals_plain_version(spark, shards):
    rows = random_turns(random.Random(shards), 200)
    got = turn_trie.conversation_trie(spark.createDataFrame(rows, TURNS), shards)
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = catalog.QUERIES["op13_turn_trie"](spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_edges(spark):
    assert turn_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    # A null turn comes first, null role and text are empty, a null id belongs to nobody, repeated
    # rows are turns of their own, and a conversation may lose all its turns.
    rows = [(0, 1, None, "b"), (0, None, "user", None), (0, 2, "user", "c"), (0, 3, "user", "c"), (None, 0, "user", "x"), (7, 0, "u", "x"), (7, 0, "u", "x"), (-3, 0, "u", "x")]
    rows += [(c, 0, "user", "only") for c in range(11, 40, 5)]
    shown = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", shard int, path string")
    got = Counter(map(tuple, turn_trie.conversation_trie(shown, 4).collect()))
    want = plain_trie([r for r in rows if r[0] is None or r[0] >= 0])
    assert sum(n for r, n in got.items() if r[1] == 0) == 1
    negative = turn_trie.conversation_trie(shown.where("conv_id >= 0 or conv_id is null"), 4)
    assert Counter(map(tuple, negative.collect())) == want
    alone = turn_trie.conversation_trie(spark.createDataFrame([(4, 0, "user", "only"), (4, 1, "user", "x")], TURNS))
    assert Counter(map(tuple, alone.collect())) == plain_trie([(4, 0, "user", "only"), (4, 1, "user", "x")])


def test_trie_hashes_long_lists_of_members_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "ID_CHUNK", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 500)]
    got = turn_trie.conversation_trie(spark.createDataFrame(rows, TURNS), 6)
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)
