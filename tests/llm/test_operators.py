"""The training-data operators against brute force on small, awkward tables."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import bpe, bpe_codec, components, decontamination, line_dedup, minhash_dedup, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filters
from quarrylight.llm.runtime import cut, fresh, shared_dir

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = r"[^\x20\x09-\x0D]+"
TALE = " ".join(f"word{i % 97}x{i * i % 89}" for i in range(400))


def near(text: str, every: int) -> str:
    return " ".join("new" if i % every == 5 else w for i, w in enumerate(text.split()))


AWKWARD = [
    (1, TALE),
    (2, near(TALE, 100)),
    (3, TALE),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, "two words"),
    (8, "Two\tWords"),
    (None, TALE.upper()),
    (9, "one"),
    (10, "ÄÖÜ straße\n" + "the same long line here\n" * 3 + "End"),
    (11, "  THE same long line here \nother line of text\n\nEnd"),
    (12, "unique line of words\n" + TALE[:900]),
    (13, "a" * 900),
    (13, "second row of thirteen, with some more words in it"),
    (14, "ab " * 400),
    (15, near(TALE, 3)),
    (16, "x <|endoftext|> y's don't  stop\u00a0\u3000 한글 🙂🙂 12345"),
    (1, TALE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in AWKWARD], "doc_id long, text string, n_lines string, __did int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts_and_codec(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    want = [(i, len((t or "").encode()), lib.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in AWKWARD]
    assert rows(token_counts.token_counts(docs, limit=300)) == sorted(((i, n, len(x), len(x) > 300) for i, n, x, _ in want), key=str)
    packed = [(i, len(x), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in x)).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, _, x, _ in want]
    assert rows(bpe_codec.encode_digests(docs)) == sorted(packed, key=str)
    back = bpe_codec.decoded(bpe_codec.encoded(docs.select("doc_id", "text"))).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
    assert rows(token_counts.token_counts(empty)) == rows(bpe_codec.encode_digests(empty)) == []


def test_prefixes_and_budgets(spark):
    from tokenizers import Tokenizer

    lib, text = Tokenizer.from_file(bpe.default_path()), "It's  the <|endoftext|> end,\n\n we'll see 'rest 2024é한 \t"
    one = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert {r.doc_id: r.counts for r in token_counts.prefix_tables(one).collect()} == {1: want, 2: [0]}
    for budget in (0, 3, 9, 1000):
        kept = {r.doc_id: (r.kept_chars, r.n_tokens) for r in token_counts.truncated(one, budget).collect()}
        best = max(k for k, n in enumerate(want) if n <= budget)
        assert kept == {1: (best, want[best]), 2: (0, 0)}
    counted = token_counts.token_counts(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")))
    assert token_counts.within_budget(counted, 31).count() == 31 // counted.first().n_tokens
    assert token_counts.within_budget(counted.limit(0), 31).count() == 0


@pytest.mark.parametrize("text", ["a" * 3000, " " * 999, "abab" * 700, "\n \n" * 200, "é" * 500])
def test_long_pieces(text):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.count(text) == len(ids) and own.decode(ids) == text


def brute_components(sets: dict, percent: int) -> dict:
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in sets}


def shingles(text, k):
    w = re.findall(SPACES, (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_copies(docs, empty, k, percent):
    found = minhash_dedup.near_copies(docs, shingle=k, percent=percent)
    sets = {n: shingles(t, k) for n, (_, t) in enumerate(AWKWARD)}
    of = brute_components(sets, percent)
    want = []
    for n, (i, _) in enumerate(AWKWARD):
        ids = [AWKWARD[m][0] for m in of if of[m] == of[n] and AWKWARD[m][0] is not None]
        least = min(ids, default=None) if sets[n] else i
        want.append((i, len(sets[n]), least, i == least))
    assert rows(found) == sorted(want, key=str)
    assert rows(minhash_dedup.near_copies(empty)) == []
    kept = minhash_dedup.drop_near_copies(docs, shingle=k, percent=percent)
    assert kept.columns == docs.columns and kept.where("doc_id in (2, 3) or doc_id is null").count() == 0


def test_only_near_copies_are_dropped(spark):
    """Rows without an id and rows that share one go by themselves."""
    alone, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "st")
    texts = [(1, TALE), (None, TALE + " end"), (None, alone), (2, TALE + " tail"), (2, other), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(minhash_dedup.drop_near_copies(df)) == sorted([(1, TALE), (None, alone), (2, other), (None, None)], key=str)


def test_near_copies_without_a_middle(spark):
    """A chain, and a crowd that shares buckets without links, next to linked ones."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[s:] + [f"v{s}x{i}" for i in range(s)]) for s in range(0, 40, 3)]
    texts += [" ".join(w if (i * 7 + k) % 9 else f"u{k}x{i}" for i, w in enumerate(base)) for k in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = brute_components({i: shingles(t, 3) for i, t in enumerate(texts)}, 85)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_copies(df, shingle=3, percent=85).collect()} == of


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in found.collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines(docs, empty, min_docs):
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    late = lambda i: 1 << 62 if i is None else i
    for i, t in AWKWARD:
        for line in (t or "").split("\n"):
            holders[key(line)].add(late(i))
    want = []
    for i, t in AWKWARD:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == late(i)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.dedup_lines(docs, min_docs=min_docs)
    assert found.columns == ["doc_id", "text", "__did", "n_lines", "n_dropped"]
    assert rows(found.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")))) == sorted(want, key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_long_texts(spark):
    text = "\n".join(f"line number {i % 700} of many" for i in range(1500))
    df = spark.createDataFrame([(1, "line number 3 of many\nline number 699 of many"), (2, text)], "doc_id long, text string")
    two = line_dedup.dedup_lines(df).where("doc_id = 2").first()
    assert two.n_dropped == 5 and two.text == "\n".join(x for x in text.split("\n") if x not in ("line number 3 of many", "line number 699 of many"))


def test_quality_features(docs, empty):
    want = []
    for i, t in AWKWARD:
        w = re.findall(SPACES, t or "")
        lines = [x for x in (t or "").split("\n") if re.search(SPACES, x)]
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed))
    found = quality_rules.judge(docs)
    assert found.columns[:4] == docs.columns and {r.n_lines for r in found.select("n_lines").collect()} == {"clash"}
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(found.select(*names)) == sorted(want, key=str)
    assert found.where("base_failed and kept").count() == 0
    assert rows(quality_rules.judge(empty)) == [] and quality_rules.judge(docs, carry=["doc_id"]).columns[:2] == ["doc_id", "n_words"]


def test_quality_estimates(spark):
    """Estimates find the rules that tell bad texts, whatever they start from."""
    good, bad = [(1, 0, 1)] * 700 + [(1, 0, 0)] * 200, [(-1, -1, 1)] * 60 + [(0, -1, 1)] * 40
    votes = spark.createDataFrame(good + bad, "a int, b int, c int")
    found = quality_rules.estimate(votes, ["a", "b", "c"])
    p = votes.select("b", quality_rules.posterior(["a", "b", "c"], found).alias("p")).groupBy("b").agg(F.avg("p").alias("p")).collect()
    assert {r.b: r.p > 0.5 for r in p} == {0: True, -1: False} and 0.8 < found["s"] < 0.95
    assert quality_rules.estimate(votes.limit(0), ["a", "b", "c"])["s"] == pytest.approx(0.75)


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    judged = quality_rules.judge(docs, carry=["doc_id"]).where("not base_failed").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right = judged.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97


def test_urls(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/en/7", "allow"), ("a.com", "", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), (None, "/", "block"), ("b.org", None, "block")]
    urls = ["http://Example.COM/en/77?q#f", "https://www.example.com/en/8", "ftp://x.com/en/", "a.com/x", None, "", "http://a.com", "http://sub.a.com/x/yz#1", "http://a.com/xz", "http://aa.com/x", "http://b.org/q", "x://", "http://a.com/w", "http://com/en/1", "http://a.com/x"]
    pages = spark.createDataFrame([(None if k == 3 else k, u, "extra") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    known = spark.createDataFrame(rules, "host string, path string, action string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.match(r"[^/?#]*", rest)[0].translate(LOW) if rest is not None else ""
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1] if rest is not None else ""
        fits = [(len(h), len(p or ""), h + (p or ""), a) for h, p, a in rules if h is not None and host and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    want = sorted(((None if k == 3 else k, *judge(u)) for k, u in enumerate(urls)), key=str)
    assert rows(url_filters.judge_urls(pages, known)) == want
    assert rows(url_filters.judge_urls(pages.limit(0), known)) == []
    assert {r.verdict for r in url_filters.judge_urls(pages, known.limit(0), default="block").collect()} == {"block"}


@pytest.mark.parametrize("most", [decontamination.MOST_WINDOWS, 0])
def test_decontamination(spark, docs, empty, most):
    items = [(1, "word1x1, word2x4! WORD3x9 word4x16 word5x25 word6x36 word7x49 word8x64 word9x81 word10x11 word11x32"), (2, "Two-words"), (3, None), (4, "..."), (None, "one"), (20, "end"), (3, "second row of thirteen"), (20, "straße")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_hit string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w and i is not None else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = []
    for i, t in AWKWARD:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= items_of
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    found = decontamination.find_hits(docs, bench, carry=["doc_id"], most_windows=most)
    assert rows(found) == sorted(want, key=str)
    assert rows(decontamination.find_hits(empty, bench, most_windows=most)) == []
    assert decontamination.find_hits(docs, bench.limit(0), most_windows=most).where("contaminated").count() == 0
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats(docs, empty, spark, most):
    length = 400
    texts = [(i, (t or "").encode()) for i, t in AWKWARD] + [(50, TALE[100:700].encode()), (51, b"q" * 400), (52, b"q" * 399), (53, ("é" * 150 + TALE[200:640]).encode())]
    more = spark.createDataFrame([(i, b.decode()) for i, b in texts[len(AWKWARD) :]], "doc_id long, text string")
    count = collections.Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    want = []
    for i, b in texts:
        gone = {j for s in range(len(b) - length + 1) if count[b[s : s + length]] > 1 for j in range(s, s + length)}
        runs = sum(1 for j in gone if j - 1 not in gone)
        want.append((i, len(b), len(gone), runs, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    assert rows(suffix_dedup.remove_repeats(docs.select("doc_id", "text").unionByName(more), most=most)) == sorted(want, key=str)
    assert rows(suffix_dedup.remove_repeats(empty)) == []


def test_repeats_in_tiles(spark, monkeypatch):
    import numpy as np

    data = np.frombuffer((TALE * 5).encode(), dtype=np.uint8)
    offsets = np.array([0, 7000, 7200, len(data)])
    gather = lambda: sorted(x for part in suffix_dedup.anchors_of(data, offsets, 400) for x in zip(*(c.tolist() for c in part), strict=True))
    whole = gather()
    monkeypatch.setattr(suffix_dedup, "TILE", 1500)
    assert gather() == whole and whole


def test_passages(spark, docs, empty):
    passage = " ".join(f"p{i}" for i in range(70))
    around = lambda k: " ".join(f"r{k}y{i}" for i in range(80))
    edited = passage.replace("p30 ", "zz ")
    texts = [(100, f"{around(1)} {passage} {around(2)}"), (101, f"{passage.upper()} {around(3)}"), (102, f"{around(4)} {edited}"), (103, around(5) + around(6)), (104, None), (105, " ".join(passage.split()[:40]) + " " + around(7))]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    found = substring_dedup.near_passages(docs.select("doc_id", "text").unionByName(more)).collect()
    words = {i: re.findall(SPACES, (t or "").translate(LOW)) for i, t in texts + AWKWARD}
    hit = {r.doc_id for r in found} | {r.partner_id for r in found}
    assert {100, 101, 102, 1, 2, 3} <= hit and not hit & {103, 104, 105, 4, 5, 6, 7, 8, 9, 14}
    for r in found:
        if r.doc_id in (13, None) or r.partner_id in (13, None):
            continue
        a, b = words[r.doc_id][r.first_word : r.end_word], words[r.partner_id][r.partner_first_word : r.partner_end_word]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(b) >= 50 and len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8
    assert rows(substring_dedup.near_passages(empty)) == []


def test_passages_without_a_leader(spark):
    """Near copies of a passage whose parts are stock phrases of other texts, which lead most of its values."""
    import random

    rng = random.Random(5)
    base = [f"p{i}" for i in range(70)]
    texts = {}
    for k in range(40):
        own = [f"g{k}{w}" for w in base]
        for part in range(0, 280, 7):
            texts[1000 * k + 100 + part] = [*(f"q{k}x{part}x{i}" for i in range(60)), *own[part % 70 : part % 70 + 12], *(f"r{k}x{part}x{i}" for i in range(60))]
        for n in range(3):
            at = rng.randrange(70) if n else -1
            texts[1000 * k + n] = [*(f"s{k}x{n}x{i}" for i in range(20)), *(f"z{k}x{n}" if i == at else w for i, w in enumerate(own)), *(f"t{k}x{n}x{i}" for i in range(20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = substring_dedup.near_passages(df).collect()
    sets = {i: {tuple(w[20:90][j : j + 5]) for j in range(66)} for i, w in texts.items() if i % 1000 < 3}
    want = {(i, j) for i in sets for j in sets if i < j and i // 1000 == j // 1000 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    label = {i: i for i in texts}
    for _ in range(4):
        for r in got:
            label[r.doc_id] = label[r.partner_id] = min(label[r.doc_id], label[r.partner_id])
    assert all(i % 1000 < 3 for r in got for i in (r.doc_id, r.partner_id))
    missed = [(i, j) for i, j in want if label[i] != label[j]]
    assert len(want) >= 80 and len(missed) <= 0.02 * len(want)


def test_passages_do_not_depend_on_the_sample(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [(k, " ".join([*(f"a{k}x{i}" for i in range(20)), passage, *(f"b{k}x{i}" for i in range(20))])) for k in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = []
    for share in (0.0, 0.1, 0.2):
        monkeypatch.setattr(substring_dedup, "SAMPLE", share)
        found.append(rows(substring_dedup.near_passages(df)))
    assert found[0] and found[0] == found[1] == found[2]


@pytest.mark.parametrize("inserted", [0, 9, 15])
def test_passages_with_inserted_words(inserted):
    """Inserted shingles that leave 80 % of the whole, between others and with strays, whichever text leads."""
    import numpy as np

    n = 4 * inserted + 60
    u = np.arange(30 + n + 30)
    v = np.concatenate([1000 + np.arange(40), u[30 : 30 + n // 2], 2000 + np.arange(inserted), u[30 + n // 2 : 30 + n], 3000 + np.arange(500), u[:1]])
    v[20] = u[-1]
    for a, b in ((u, v), (v, u)):
        found = substring_dedup.passages(a.astype(np.uint32), b.astype(np.uint32), 46, 80)
        assert len(found) == 1 and found[0][1] - found[0][0] + 1 >= n and found[0][4] >= 0.8


def test_compact_windows():
    import numpy as np

    rng = np.random.default_rng(3)
    first = np.array([0, 60, 60, 75, 200])
    a = rng.permutation(200).astype(np.uint64) + 1
    got = sorted(zip(*(x.tolist() for x in substring_dedup.compact_windows(a, first, 10)), strict=True))
    want = []
    for s, e in zip(first, first[1:], strict=False):
        for c in range(s, e):
            left = c
            while left > s and a[left - 1] > a[c]:
                left -= 1
            right = c
            while right < e - 1 and a[right + 1] > a[c]:
                right += 1
            if right - left + 1 >= 10:
                want.append((c, left, right))
    assert got == sorted((int(c), int(x), int(y)) for c, x, y in want)


def test_runtime(spark, docs):
    assert shared_dir(spark).startswith("file:///") and cut(docs.limit(1)).count() == 1
    assert fresh(docs, "did", "x") == ["___did", "__x"]


def test_passages_recall(spark):
    """Pairs of texts that share enough shingles and hold a similar passage (all pairs tried) are connected, but for 1 % at most."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    numbers: dict[tuple, int] = {}
    series = []
    for i in ids:
        w = re.findall(SPACES, texts[i].translate(LOW))
        series.append(np.array([numbers.setdefault(tuple(w[j : j + 5]), len(numbers)) for j in range(len(w) - 4)], dtype=np.uint32))
    holders = collections.defaultdict(list)
    for n, s in enumerate(series):
        for x in set(s.tolist()):
            holders[x].append(n)
    common = collections.Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    want = [(ids[a], ids[b]) for (a, b), n in common.items() if n >= 37 and substring_dedup.passages(series[a], series[b], 46, 80)]
    found = substring_dedup.near_passages(docs).select("doc_id", "partner_id").collect()
    label = {i: i for i in ids}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        a, b = sorted((top(r.doc_id), top(r.partner_id)))
        label[b] = a
    missed = [x for x in want if top(x[0]) != top(x[1])]
    assert len(want) > 100 and len(missed) <= 0.01 * len(want), (len(want), missed[:5])


@pytest.mark.parametrize("spread", [1, 7])
def test_passages_in_crowds(spark, spread):
    """Near copies of one passage in more texts than are linked with each other, stock lines in all of them and in clean ones."""
    import random

    rng = random.Random(9)
    stock, texts = " ".join(f"stock{i}" for i in range(25)), {}
    for g in range(3):
        base = [f"p{g}x{i}" for i in range(120)]
        for n in range(40):
            w = list(base)
            w[rng.randrange(120)] = f"z{g}x{n}"
            texts[100 * g + n] = " ".join([*(f"s{g}x{n}x{i}" for i in range(30)), *w, stock, *(f"t{g}x{n}x{i}" for i in range(30))])
    for n in range(200):
        texts[1000 + n] = " ".join([*(f"c{n}x{i}" for i in range(80)), stock, *(f"d{n}x{i}" for i in range(80))])
    texts[2000], texts[2001], texts[None] = texts[0], texts[1000], texts[100]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(spread)
    label = {i: i for i in texts if i is not None}
    got = substring_dedup.near_passages(df).collect()
    for _ in range(6):
        for r in got:
            if r.doc_id is not None and r.partner_id is not None:
                label[r.doc_id] = label[r.partner_id] = min(label[r.doc_id], label[r.partner_id])
    assert all(label[100 * g + n] == 100 * g for g in range(3) for n in range(40)) and label[2000] == 0
    assert label[2001] == 1000 and all(label[i] == i for i in texts if i is not None and 1000 <= i < 2000)
    assert [(r.partner_id, r.first_word, r.end_word) for r in got if r.doc_id is None] == [(100, 0, 205)]


def test_windows_with_long_sides():
    """A side that is too long for its bits reaches to the text's ends."""
    import numpy as np

    l, r = substring_dedup.unpack(substring_dedup.pack(np.array([200000, 50]), np.array([0, 20]), np.array([600000, 70])))  # noqa: E741
    assert l.tolist() == [0, 20] and r[0] >= 600000 and r[1] == 70
    assert substring_dedup.unpack(int(substring_dedup.pack(np.array([9]), np.array([2]), np.array([30]))[0])) == (2, 30)
