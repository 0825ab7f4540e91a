"""Prefix trie, cross-tokenizer alignment and folded BPE against brute force and the tokenizer libraries."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import bpe, byte_fold, cross_tokens, prefix_trie

WORDS = r"[^\x20\x09-\x0D]+"
TEXTS = [
    (1, "a" * 300),
    (2, None),
    (3, ""),
    (4, "x <|endoftext|> y's <s> don't  stop 　 한글 🙂🙂 12345 \x00\x1c\x85 ࡰab \U00010d40"),
    (None, "汉字" * 150),
    (6, " \n\n\t "),
    (7, "▁lit"),
    (8, "<0x41> and <unk>"),
    (9, "The same text.\nThe same text."),
    (9, "The same text.\nThe same text."),
    (10, "Several words " * 4000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in TEXTS], "doc_id long, text string, ids string, key int")


def rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_folded_bpe(spark, docs, monkeypatch):
    import public_tokenizers
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_fold.load_ranks(byte_fold.default_path()), special_tokens={})
    want = []
    for i, t in TEXTS:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(byte_fold.encode_digests(docs)) == sorted(want, key=str)
    monkeypatch.setattr(byte_fold, "HOT", 2)  # nearly all words go by the join
    assert rows(byte_fold.encode_digests(docs)) == sorted(want, key=str)
    assert rows(byte_fold.encode_digests(docs.limit(0))) == []


def test_split_pattern_knows_the_librarys_letters(spark):
    import public_tokenizers
    import regex
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | {b"a" + bytes([b]): 256 + b for b in range(256)}, special_tokens={})
    # After "a", a letter's first byte is merged with it; what isn't a letter starts a word of its own.
    chars = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    want = {c for c in chars if lib.encode_ordinary("a" + c)[0] > 255}
    found = spark.createDataFrame([(c,) for c in chars], "c string").where(F.size(F.regexp_extract_all(F.concat(F.lit("a"), "c"), F.lit(byte_fold.split_pattern(spark)), F.lit(0))) == 1)
    assert {r.c for r in found.collect()} == want and regex.match(r"\p{L}", "ࡰ")


def brute_alignment(texts) -> list:
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = cross_tokens.default_paths()
    lib, pieces, of = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), bpe._byte_of_char()
    lib.encode_special_tokens = True
    found, counts = [], collections.Counter()
    for i, t in texts:
        a = b = []
        if t:
            a = [(x, bytes(of[c] for c in lib.id_to_token(x))) for x in lib.encode(" " + t, add_special_tokens=False).ids]
            b = [(x, bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode()) for x in pieces.encode(t)]
            if any(b"".join(x for _, x in side) != (" " + t).encode() for side in (a, b)):
                a = b = []
        ends = []
        for side in (a, b):
            at, mine = 0, {}
            for k, (_, x) in enumerate(side):
                at += len(x)
                mine[at] = k
            ends.append(mine)
        common, groups, last = sorted(set(ends[0]) & set(ends[1])), [], (0, 0)
        for e in common:
            now = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(str(x) for x, _ in a[last[0] : now[0]]) + "|" + ",".join(str(x) for x, _ in b[last[1] : now[1]]))
            last = now
        links = [(a[ends[0][e]][0], b[ends[1][e]][0]) for e in common]
        counts.update(links)
        found.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(i, na, nb, len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), g) for i, na, nb, x, g in found]


def test_alignment(docs, monkeypatch):
    want = sorted(brute_alignment(TEXTS), key=str)
    assert rows(cross_tokens.align(docs)) == want
    monkeypatch.setattr(cross_tokens, "FREQUENT", 3)  # nearly all pairs go by the join
    monkeypatch.setattr(cross_tokens, "HELD", 10)
    assert rows(cross_tokens.align(docs)) == want
    assert rows(cross_tokens.align(docs.limit(0))) == []


def brute_trie(turns) -> list:
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        paths[c] = [x[3:] for x in sorted(own.get(base, []))[:h]] + [x[3:] for x in sorted(mine)[h:]]
    members, below, leaves, saved, out = collections.defaultdict(list), collections.defaultdict(list), {}, {}, []
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    for n in members:
        if n:
            below[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORDS, n[-1][1])) if n else 0
        leaves[n] = sum(leaves[x] for x in below[n]) or 1
        saved[n] = (len(members[n]) - 1) * words + sum(saved[x] for x in below[n])
        ends = ",".join(str(c) for c in members[n] if len(paths[c]) == len(n))
        out.append((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(below[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = (
    [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c // 7} with some words" if t > 1 else f"hello {c % 3}") for c in range(-25, 60) for t in range(c % 6)]
    + [(5, None, "user", "first"), (5, 1, None, "x"), (5, 1, "user", None), (None, 0, "user", "lost"), (1003, 0, "u", "alone"), (1003, 0, "u", "alone")]
    + [(5000 + i, 0, "user", "the same first turn") for i in range(200)]
    + [(6000, t, "user", f"long {t}") for t in range(500)]
)


def test_prefix_trie(spark, monkeypatch):
    table = spark.createDataFrame([(*x, "clash", 1.0) for x in TURNS], "conv_id long, turn long, role string, text string, depth string, conv double")
    want = brute_trie(TURNS)
    assert rows(prefix_trie.prefix_trie(table.repartition(7))) == want
    monkeypatch.setattr(prefix_trie, "JOINED", 3)
    assert rows(prefix_trie.prefix_trie(table)) == want
    assert rows(prefix_trie.prefix_trie(table.limit(0))) == []
