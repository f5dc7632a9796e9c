"""The training-data operators against brute force, round trips, held-out labels and SQL."""

import base64
import hashlib
import math
import random
import re
import zlib
from itertools import combinations, product
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, common, components, decontam, dedup, jaccard, licenses, queries, quality, secrets_scan, toxicity, warc
from lectern.llm.license_texts import KNOWN_LICENSES

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, key string, id int, rep long, row int, _h string, keep_id int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, "h", 4) for i, t in zip(ids, texts, strict=True)], EXTRA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- words -----------------------------------------------------------------------------------


def test_words_and_shingles():
    plain = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", common.WIDE_GAPS.sub(" ", t.lower()))
    rng = random.Random(3)
    for t in ("", "  ", "One two—three, ÉTÉ x_y 'q'", "z" * 700_000 + " end", "".join(rng.choice("ab Éx,.\n“") for _ in range(5000))):
        data = common.folded(t)
        h, s, e = common.words_of(data)
        assert [data[a:b].decode() for a, b in zip(s, e, strict=True)] == plain(t)
    alone = common.words_of(b"z" * 700_000)[0][0]
    for before in ("", "a ", "word " * 52_428, "q" * 300_000 + " ", "x" * ((1 << 18) - 1) + " "):  # at any place a long word is one and the same
        h, s, e = common.words_of(common.folded(before + "z" * 700_000 + " end"))
        assert len(h) == len(before.split()) + 2 and h[-2] == alone and e[-2] - s[-2] == 700_000
        assert h[-1] == common.words_of(b"end")[0][0]
    assert common.shingles("A b, c d e") [0] == common.shingles("a B c d E")[0] and len(common.shingles("")) == 1
    assert len(common.shingles("a b c d e f")) == 2


# --- 1 ---------------------------------------------------------------------------------------


def test_secret_base_spans_are_the_patterns():
    rng = random.Random(1)
    parts = ["password", "PassWd", "api_key", "apikey", "token", "ſecret", "secret", "'", '"', " ", ":", "=", "abc123+/_.-", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3, "x", "é", "0f" * 13, "\n"]
    kinds = [(re.compile(secrets_scan.ASSIGN.pattern, re.I | re.A), 2, 6), (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), (re.compile(r"[0-9a-f]+"), 0, 24)]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in p.finditer(t) if len(m[g]) >= n)
        assert secrets_scan.scan_text(t)["base"] == want


def is_date(text):
    """A year, or year-month-day or day-month-year with one sign (or none) between the parts."""
    if re.fullmatch(r"(19|20)[0-9]{2}", text):
        return True
    for sign in ("", "-", "/", ".", "_"):
        for a, b in combinations(range(1, len(text)), 2):
            x, y, z = text[:a], text[a:b], text[b:]
            if sign:
                if not (x.endswith(sign) and y.endswith(sign)):
                    continue
                x, y = x[:-1], y[:-1]
            for year, month, day in ((x, y, z), (z, y, x)):
                number = lambda v, top: re.fullmatch("[0-9]{1,2}", v) and 1 <= int(v) <= top
                if re.fullmatch(r"(19|20)[0-9]{2}", year) and number(month, 12) and number(day, 31):
                    return True
    return False


def brute_cost(value):
    """The least cost over all segmentations, every segment looked at by itself."""
    per = secrets_scan._alphabet(value)
    low, n = value.lower(), len(value)

    def seg(i, j):
        own, k, out = low[i:j], j - i, [(j - i) * per]
        out += [c for m, c in secrets_scan._word_costs(value, i) if m == k]
        if is_date(value[i:j]):
            out.append(math.log10(365 * 130) if k > 4 else math.log10(130))
        if k >= 3 and len(set(own)) == 1:
            out.append(per + math.log10(k))
        if k >= 3 and all(b in secrets_scan.NEAR.get(a, ()) for a, b in zip(own, own[1:])):
            out.append(math.log10(47 * 4) + math.log10(k) + (k - 1) * math.log10(1.6))
        out += [size * per + math.log10(k // size) for size in (2, 3, 4) if k >= 2 * size and k % size == 0 and own == own[:size] * (k // size)]
        return min(out) + secrets_scan.PER_SEGMENT

    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + seg(i, j) for i in range(j))
    return best[n]


KEYS_40 = "qwertyuioplkjhgfdsazxcvbnmjuytrewqasdfgh"
GUESSED = ["password1", "qwertyui", "aaaaaa", "abab12", "2019x7", "P@ssw0rd", "x9$Kq!", "admin123", "asdf1990", "20191231", "20200115", "2019-12-31", "20191234", "31/12/2019", "1.1.2020", "x2019_1_1y", "12-1-20199", "abcabcabcabcabca", KEYS_40, KEYS_40 + "zz9", "a" * 50 + "word", "xyxyxyxyxyxyxyx2019-1-12aaaa", "kkkkpassword" * 4]


@pytest.mark.parametrize("value", GUESSED)
def test_guess_cost_is_the_least_over_segmentations(value):
    assert secrets_scan.log10_guesses(value) == pytest.approx(brute_cost(value))


def test_guess_costs_of_random_values():
    rng = random.Random(31)
    parts = ["a", "aa", "ab", "abc", "qwe", "1", "2019", "12", "31", "-", "/", "pass", "word", "Z", "$", "é", "0", "9876"]
    for _ in range(400):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 22)))
        assert secrets_scan.log10_guesses(value) == pytest.approx(brute_cost(value)), value
    for i in range(200):
        value = "".join(rng.choice("0123/-19") for _ in range(12))
        assert secrets_scan._date_lengths(value, 0) == {k for k in range(1, 13) if is_date(value[:k])}, value


def test_guess_spans_of_whole_texts():
    rng = random.Random(32)
    words = ["password", "dbSecret", "x", "token", "api-key", "PIN", "name"]
    values = ["x9$Kq!vR2#mT", "changeme123", "p$7&kQ!z0@Lw#9", "aaaaaaaaaaaa", "k3!", "2019-12-31", "Tr0ub4dor&3xyz!"]
    for _ in range(150):
        chosen = [(rng.choice(words), rng.choice(values)) for _ in range(6)]
        text = " and ".join(f'{name}="{value}"' for name, value in chosen)
        want, at = [], 0
        for name, value in chosen:
            at = text.index(f'{name}="{value}"', at) + len(name) + 2
            if any(k in name.lower() for k in ("password", "secret", "token", "api-key")) and len(value) >= 6 and brute_cost(value) >= secrets_scan.MIN_LOG10_GUESSES:
                want.append((at, at + len(value)))
        assert [(a, b) for a, _, b, _ in secrets_scan.guess_spans(text)] == want


def test_secret_scan_of_awkward_texts():
    import time

    began = time.time()
    assert secrets_scan.scan_text("secret " + "a-" * 100_000)["all"] == []
    assert time.time() - began < 5  # time in proportion to the length
    assert secrets_scan.scan_text("password: " + "\u0130" * 12)["base"] == []  # a letter whose lower case is longer
    assert secrets_scan.log10_guesses("\u0130x\u01309!Kq\u0130") > 0
    found = secrets_scan.scan_text("my.db-password=x9$Kq!vR2#mT")["guess"]
    assert [(a, b) for a, _, b, _ in found] == [(15, 27)]


@pytest.mark.parametrize(
    "text",
    [
        'dbPassword = "x9$Kq!vR2#mT"', '"clientSecret": "p$7&kQ!z0@Lw#9"', "accessToken: x9$Kq!vR2#mT", "USERPASSWORD='x9$Kq!vR2#mT'", 'SECRET_KEY = "x9$Kq!vR2#mT"',
        "secret_" + "k" * 100 + "=x9$Kq!vR2#mT", "myApiKeyForProd := x9$Kq!vR2#mT", "tokenNames: pwd: x9$Kq!vR2#mT", 'a_secretName:password="x9$Kq!vR2#mT"', "passwords => x9$Kq!vR2#mT",
    ],
)
def test_secret_names_around_the_keyword(text):
    value = "p$7&kQ!z0@Lw#9" if "clientSecret" in text else "x9$Kq!vR2#mT"
    assert [text[a:b] for a, _, b, _ in secrets_scan.guess_spans(text)] == [value]


def test_secret_names_in_linear_time():
    import time

    began = time.time()
    for t in ("secret" * 100_000, "password-token_" * 50_000 + "!", "pwd=" * 30_000, "secret:" * 30_000, "token " + " " * 300_000 + "token", "token=" + "k" * 100_000):
        secrets_scan.guess_spans(t)
    assert time.time() - began < 20


def test_secret_scan_rows(spark):
    t = 'db_password: "x9$Kq!vR2#mT" and pwd=changeme123 secret=aaaaaaa1'
    got = secrets_scan.secret_scan(docs(spark, [t, None, "", "clean text", t], [1, 2, 3, 4, 1])).collect()
    assert [r.n_guess for r in got] == [1, 0, 0, 0, 1] and got[1].spans == "" and got[0].n_assign == 1
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    kind, a, b = next(x for x in got[0].spans.split(",") if x.startswith("guess")).split(":")
    assert t[int(a) : int(b)] == "x9$Kq!vR2#mT"
    assert secrets_scan.secret_scan(docs(spark, [])).count() == 0
    assert secrets_scan.log10_guesses("k" * 100_000) < 20 < secrets_scan.log10_guesses("x9$Kq!vR" * 3 + "zz81")


# --- 2 and 3 ---------------------------------------------------------------------------------


def brute_links(texts):
    sets = [frozenset(common.shingles(t).tolist()) for t in texts]
    n = [0] * len(texts)
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            n[i] += 1
            n[j] += 1
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return n, root


def near_texts(seed=5):
    rng = random.Random(seed)
    out = [None, "", "one two", "one two", "One  two!"]
    for _ in range(6):
        base = sentence(rng, 120).split()
        out += [" ".join(base)] * 2
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    hot = sentence(rng, 200).split()
    out += [" ".join([*hot[:k], f"w{k}", *hot[k + 1 :]]) for k in range(0, 200, 3)]
    return [*out, *(sentence(rng, 60) for _ in range(20))]


@pytest.mark.parametrize(("block", "size", "pairs", "hot"), [(1024, 1 << 24, 1 << 17, 1000), (8, 1 << 24, 50, 1), (1024, 5000, 1 << 17, 1000)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, block, size, pairs, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(common, "HOT", hot)
    texts = near_texts()
    links, root = brute_links(texts)
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs(spark, texts))["documents"].collect()}
    assert [got[i].class_id for i in range(len(texts))] == root
    assert [got[i].n_links for i in range(len(texts))] == links


def test_jaccard_edges(spark):
    assert jaccard.jaccard_join(docs(spark, []))["documents"].count() == 0
    long = "word " * 300_000
    got = jaccard.jaccard_join(docs(spark, ["a b c d e f", "a b c d e f", long, "x"], [None, 7, 8, 8]))["documents"].collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == [("7", 1), ("8", 0), ("8", 0), ("None", 1)]


@pytest.mark.parametrize("least", [0, 100_000])
def test_near_copies_go_by_id_and_text(spark, monkeypatch, least):
    monkeypatch.setattr(common, "BROADCAST_ROWS", least)
    rng = random.Random(21)
    one, two = sentence(rng, 120), sentence(rng, 120)
    near = lambda t, k: " ".join([*t.split()[:k], "changed", *t.split()[k + 1 :]])
    rows = [(1, one), (7, near(one, 3)), (7, "a text like no other one here"), (None, near(one, 60)), (None, near(two, 5)), (None, near(two, 70)), (None, "x"), (None, "y"), (None, "y"), (9, "z"), (9, "z"), (3, two + "!"), (3, two)]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = jaccard.drop_near_copies(frame)
    got = sorted((str(r.doc_id), common.folded(r.text).decode()[:20].strip(" !")) for r in kept.collect())
    assert got == sorted([("1", one[:20].strip()), ("7", "a text like no other"), ("None", "x"), ("None", "y"), ("9", "z"), ("3", two[:20].strip())])
    assert kept.columns == frame.columns and jaccard.drop_near_copies(docs(spark, [])).count() == 0
    links = jaccard.jaccard_join(frame)["documents"].collect()
    assert sorted(r.n_links for r in links) == sorted([2, 2, 2, 0, 3, 3, 3, 3, 0, 1, 1, 1, 1])


def test_prune_limits_keep_similar_pairs():
    assert all(sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least)) < 1e-5 for n, least in jaccard.prune_limits())


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, None), (9, 9)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(len(root)):
        for a, b in edges:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("least", "hot", "stages"), [(100_000, 1000, 6), (30, 1000, None), (0, 1000, None), (0, 1, None)])
def test_few_links_take_few_stages(spark, monkeypatch, least, hot, stages):
    monkeypatch.setattr(common, "BROADCAST_ROWS", least)  # 30: rounds first, one task when fewer links are left
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] * 2 + [(100 + k, 100) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(-7, 1 << 60)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    links = spark.createDataFrame([*edges, (None, 3), (500, 500)], "a long, b long")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before, group = {p.name for p in folder.iterdir()}, f"components-{least}-{hot}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        got = components.connected_components(links).collect()
        names = links.select(F.col("a").cast("string"), F.col("b").cast("string"))
        named = components.connected_components(names).collect()
        tracker = spark.sparkContext.statusTracker()
        ran = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len(linked) and {r.node: r.root for r in got} == {x: root[x] for x in linked}
    least_name = {}
    for x in linked:
        least_name[root[x]] = min(least_name.get(root[x], str(x)), str(x))
    assert {r.node: r.root for r in named} == {str(x): least_name[root[x]] for x in linked}
    assert stages is None or ran <= 2 * stages
    assert len({p.name for p in folder.iterdir()} - before) <= 2  # the last round's files, of both runs


def test_exact_dedup(spark):
    texts = ["a  b", "a\tb", None, "", "c", "c", "A b", "c"]
    ids = [5, 3, 1, 9, 4, 4, 2, None]
    for hash_fn in (dedup.content_hash, lambda norm: b"0"):  # the second makes every text collide
        got = dedup.exact_dedup(docs(spark, texts, ids), hash_fn=hash_fn).collect()
        assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in got) == sorted(
            [("5", 3, 2, False), ("3", 3, 2, True), ("1", 1, 2, True), ("9", 1, 2, False), ("4", 4, 3, True), ("4", 4, 3, True), ("2", 2, 1, True), ("None", 4, 3, False)]
        )
        assert {r.text_sha256 for r in got if r.doc_id == 5} == {hashlib.sha256(b"a b").hexdigest()}
    kept = dedup.drop_exact_copies(docs(spark, texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == docs(spark, []).columns
    assert dedup.exact_dedup(docs(spark, [])).count() == dedup.drop_exact_copies(docs(spark, [])).count() == 0


REPEATED = [(1, "a"), (7, "a"), (7, "b"), (7, "b"), (4, "c  c"), (4, "c c"), (None, "x"), (None, "y"), (None, "z"), (None, "z"), (None, "a")]


@pytest.mark.parametrize("least", [0, 100_000])
def test_rows_go_by_id_and_text(spark, monkeypatch, least):
    monkeypatch.setattr(common, "BROADCAST_ROWS", least)  # 0: every join is a shuffle
    kept = dedup.drop_exact_copies(docs(spark, [t for _, t in REPEATED], [i for i, _ in REPEATED])).collect()
    got = sorted((str(r.doc_id), common_text(r.text)) for r in kept)
    assert got == [("1", "a"), ("4", "c c"), ("7", "b"), ("None", "x"), ("None", "y"), ("None", "z")]


def common_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text)


@pytest.mark.parametrize("hot", [1, 1000])
def test_exact_dedup_of_hot_groups_and_long_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    texts = ["same\t text"] * 40 + [f"own {k % 30}" for k in range(50)] + [" " * 3_000_000 + "end", "\n" * 70_000 + "end"]
    got = {r.doc_id: r for r in dedup.exact_dedup(docs(spark, texts)).collect()}
    norm = [common_text(t) for t in texts]
    assert [(got[i].keep_id, got[i].group_size) for i in range(len(texts))] == [(norm.index(t), norm.count(t)) for t in norm]
    assert all(got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(norm))


# --- 4 ---------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="session")
def codec():
    return bpe.Codec(bpe.load_ranks(VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="session")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(codec, library):
    rng = random.Random(4)
    real = [r[0] for r in duckdb.connect().execute(f"select text from '{SF}/documents.parquet' limit 60").fetchall()]
    odd = ["".join(rng.choice("ab \n\t'srevlmé日本🙂1²,.!") for _ in range(300)) for _ in range(60)]
    for t in [*real, *odd, "", "x" * 3000, "ab" * 900, " " * 500 + "a", "<|endoftext|>", "don't we'll I'd"]:
        ids = codec.encode(t)
        assert ids.tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_pieces_merged_together_equal_the_library(codec, library):
    rng = random.Random(9)
    pieces = ["".join(rng.choice("theinrsa é日🙂-") for _ in range(n)) for n in range(1, bpe.SHORT + 9) for _ in range(6)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merged([p.encode() for p in pieces])] == [library._core_bpe.encode_single_piece(p.encode()) for p in pieces]
    assert codec.merged([]) == []


def test_texts_encoded_together_equal_each_alone(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 400)
    monkeypatch.setattr(bpe, "TOGETHER", 1000)
    monkeypatch.setattr(bpe, "CACHE", 50)
    rng = random.Random(10)
    texts = [None, "", *("".join(rng.choice("theinr  é1\n'") for _ in range(rng.choice([0, 3, 90, 399, 2000]))) for _ in range(60)), None]
    got = [np.frombuffer(b"".join(parts), "<u4").tolist() for parts in codec.encode_texts(iter(texts))]
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_chunks_meet_again():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(6)
    for k in range(300):
        t = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "'", "12", "!!", "é"]) for _ in range(400))
        t = t if k % 3 else t[:100] + "x" * 200 + t[100:]
        chunked = [p for part in bpe.pretokenise(pattern, t, chunk=rng.randint(5, 60), overlap=rng.randint(2, 20)) for p in part]
        assert chunked == pattern.findall(t)


def test_tokenise_rows(spark, library):
    texts = [None, "", "Hello world", "word " * 60_000]
    got = bpe.tokenise(docs(spark, texts), VOCABULARY, public_tokenizers.PATTERN, with_ids=True).orderBy("doc_id").collect()
    assert bpe.tokenise(docs(spark, []), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    for t, r in zip(texts, got, strict=True):
        ids = library.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize(("part", "overlap"), [(1 << 18, 1 << 12), (500, 40)])
def test_long_texts_in_parts_equal_the_library(spark, library, monkeypatch, part, overlap):
    monkeypatch.setattr(bpe, "LONG", 2000)
    monkeypatch.setattr(bpe, "PART", part)
    monkeypatch.setattr(bpe, "PART_OVERLAP", overlap)
    monkeypatch.setattr(bpe, "PARTS_AT_ONCE", 3 * part)
    rng = random.Random(51)
    odd = lambda n: "".join(rng.choice(["a", "word ", "  ", "\n", "'s", "12", "!!", "é", "日本", "🙂", " \n "]) for _ in range(n))
    texts = [odd(4000), "short", None, odd(700) + "x" * 2500 + odd(700), " " * 5000 + "end", odd(3000), odd(3000)[:2000], "y" * 2001]
    ids = [1, 2, 3, None, 5, 1, 7, 8]
    got = bpe.tokenise(docs(spark, texts, ids), VOCABULARY, public_tokenizers.PATTERN, with_ids=True).collect()
    want = [library.encode_ordinary(t or "") for t in texts]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids) for r in got) == sorted((str(i), len(w), w) for i, w in zip(ids, want, strict=True))
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for t in texts}


def test_a_text_of_fifty_megabytes(spark, library):
    rng = random.Random(52)
    block = " ".join(sentence(rng, 9).capitalize() + rng.choice(". , \n\n ... 2024".split(" ")) for _ in range(5000))
    text = block * (50_000_000 // len(block))
    row = bpe.tokenise(docs(spark, [text], [7]), VOCABULARY, public_tokenizers.PATTERN).first()
    ids = np.array(library.encode_ordinary(text), dtype="<u4")
    assert (row.doc_id, row.n_tokens, row.ids_sha256) == (7, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# --- 5 and 9 ---------------------------------------------------------------------------------


def test_gradients_are_slopes():
    net, texts = toxicity.Network(), ["some bad words here", "a clean text of words", "one"]
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    v = toxicity.Vocabulary(texts)
    places, _ = v.windows()
    y, w, drop = np.array([1.0, 0, 1]), np.array([1.0, 2, 1]), np.ones(len(v.words))
    part = v.part(np.arange(len(v.words)))

    def loss():
        z = net.forward(np.vstack([np.zeros((1, 16)), net.inputs(part, drop)]) @ net.p["wx"] + net.p["bx"], places).astype(float)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum() / 3)

    g = net.gradients(part, places, y, w, drop)
    for name in ("wo", "wa", "va", "uf", "ub", "wx", "bx"):
        p = net.p[name]
        at = np.unravel_index(int(np.argmax(np.abs(g[name]))), p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        slope = (up - loss()) / 2e-2
        p[at] = old
        assert slope == pytest.approx(float(g[name][at]), rel=0.15, abs=2e-4), name


def plain_logit(net, rows):
    """The network's answer for one window, with plain loops: rows is a word row and character rows per place."""
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    h, dot = toxicity.HIDDEN, lambda x, m, k: sum(a * b[k] for a, b in zip(x, m))
    sig = lambda v: 1 / (1 + math.exp(-v))
    xs = []
    for word, chars in rows:
        own = p["word"][word] + [sum(p["char"][c][d] for c in chars) / math.sqrt(len(chars)) for d in range(toxicity.CHAR_DIM)]
        xs.append([dot(own, p["wx"], k) + p["bx"][k] for k in range(6 * h)])

    def run(xs, u):
        state, out = [0.0] * h, []
        for x in xs:
            a = [dot(state, u, k) for k in range(3 * h)]
            z, r = [sig(x[k] + a[k]) for k in range(h)], [sig(x[h + k] + a[h + k]) for k in range(h)]
            n = [math.tanh(x[2 * h + k] + r[k] * a[2 * h + k]) for k in range(h)]
            state = [(1 - z[k]) * n[k] + z[k] * state[k] for k in range(h)]
            out.append(state)
        return out

    one, two = run([x[: 3 * h] for x in xs], p["uf"]), run([x[3 * h :] for x in xs][::-1], p["ub"])[::-1]
    states = [a + b for a, b in zip(one, two)]
    weight = [math.exp(sum(math.tanh(dot(s, p["wa"], k)) * p["va"][k] for k in range(h))) for s in states]
    pooled = [sum(w * s[k] for w, s in zip(weight, states)) / sum(weight) for k in range(2 * h)]
    return sum(a * b for a, b in zip(pooled, p["wo"])) + p["bo"][0]


def test_scores_equal_plain_loops():
    rng = random.Random(41)
    net = toxicity.Network(seed=3)
    net.p = {k: v + np.float32(0.05) * np.random.default_rng(1).normal(size=v.shape).astype(np.float32) for k, v in net.p.items()}
    net.shift = 0.1
    texts = ["one", "some bad words here", sentence(rng, 33), sentence(rng, 70), "x" * 50 + " tail"]
    for text, (n, score) in zip(texts, zip(*net.scored(texts)), strict=True):
        v = toxicity.Vocabulary([text])
        part = v.part(np.arange(len(v.words)))
        rows = [(int(part.word_rows[k - 1]), part.rows[part.begin[k - 1] : part.begin[k - 1] + part.count[k - 1]].tolist()) for k in v.places.tolist()]
        starts = [0] if len(rows) <= toxicity.WINDOW else [*range(0, len(rows) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)]
        logits = [plain_logit(net, rows[a : a + toxicity.WINDOW]) for a in starts if a < len(rows)]
        assert n == len(logits) and score == pytest.approx(1 / (1 + math.exp(net.shift - max(logits))), abs=1e-4)


def test_stretches_hold_texts_and_bytes():
    rng = random.Random(42)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 40, None]) for _ in range(rng.randint(0, 30))]
        got = [*toxicity.stretches(sizes, 4, 50)]
        assert [k for a, b in got for k in range(a, b)] == [*range(len(sizes))]
        assert all(b - a <= 4 and (b - a == 1 or sum(x or 0 for x in sizes[a:b]) <= 50) for a, b in got)


def test_ranking_is_the_least_loss_over_pairs():
    """No change of the weights lowers the Bradley-Terry loss, added up pair by pair in plain loops."""
    rng = np.random.default_rng(43)
    x, y = rng.normal(size=(60, quality.N_FEATURES)), np.arange(60) % 2
    x[:, 0] += y
    model = quality.RankModel().fit(x, y)
    phi = model.expand(x)
    pick = np.random.default_rng(quality.SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(pick.choice(good, quality.PAIRS).tolist(), pick.choice(bad, quality.PAIRS).tolist(), strict=True))[:]

    def loss(w):
        raw = [sum(a * b for a, b in zip(row, w)) for row in phi.tolist()]
        return sum(math.log1p(math.exp(raw[b] - raw[a])) for a, b in pairs) / len(pairs) + 0.0005 * sum(a * a for a in w)

    w = model.weight.tolist()
    least = loss(w)
    for k in range(0, len(w), 5):
        for step in (-0.02, 0.02):
            assert loss([v + step * (i == k) for i, v in enumerate(w)]) > least
    scores = model.score(x)
    assert all((phi[a] @ model.weight > phi[b] @ model.weight) == (scores[a] > scores[b]) for a, b in pairs[:500])


def test_quality_is_learnt_from_every_labelled_document(spark, monkeypatch):
    """Long ones too; ids that are broadcast or not, blocks that are few or many."""
    rng = random.Random(51)
    texts = ["$$ !! ## " * (3 + k % 5) if k % 7 == 0 else sentence(rng, 40 + k % 9).capitalize() + "." for k in range(240)]
    texts[3] = "A long text of plain words. " * 9000
    frame, labels = docs(spark, texts, range(240)), spark.createDataFrame([(k, int(k % 7 != 0)) for k in range(240)], "doc_id long, quality int")
    own = [k for k in range(240) if zlib.crc32(str(k).encode()) % 4 != 2]
    x = np.array([quality.features(texts[k]) for k in own])
    model = quality.fit_quality(frame, labels)
    assert 3 in own and np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))
    raw = np.sort(model.expand(x) @ model.weight)
    k = sum(k % 7 == 0 for k in own)
    assert raw[k - 1] < model.cut < raw[k]
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    again = quality.fit_quality(frame, labels)
    assert np.allclose(again.weight, model.weight) and math.isclose(again.cut, model.cut)
    monkeypatch.setattr(quality, "BLOCK", 16)
    monkeypatch.setattr(quality, "BUCKETS", 3)
    many = quality.fit_quality(frame, labels)
    assert np.allclose(many.mean, model.mean) and ((many.score(x) >= 0.7) == np.array([k % 7 != 0 for k in own])).all()


@pytest.mark.parametrize(("n", "m"), [(1, 1), (3, 50), (50, 3), (40, 40), (300, 2000)])
def test_block_pairs_hold_every_document(n, m):
    got = np.vstack([*quality.block_pairs(np.arange(n)[:, None] * 10_000.0, -np.arange(m)[:, None] - 1.0)]).ravel().astype(int)
    pairs = {((v - 1) // 10_000, (v - 1) % 10_000) for v in got.tolist()}
    assert len(pairs) == len(got) and {a for a, _ in pairs} == set(range(n)) and {b for _, b in pairs} == set(range(m))
    assert len(got) == min(n * m, max(quality.PARTNERS, quality.PAIRS // max(n, m)) * max(n, m))


def test_drop_poor_keeps_rows_as_they_are(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rng = random.Random(44)
    good = [sentence(rng, 60).capitalize() + "." for _ in range(20)]
    texts = [good[k // 2] if k % 2 else "$$ !! ## " * 30 for k in range(40)] + [None, "", good[0], good[0]]
    frame = docs(spark, texts, [*range(40), None, 41, None, 7])
    kept = quality.drop_poor(frame, labels)
    got = kept.collect()
    assert kept.columns == frame.columns and {r.text for r in got} >= set(good) and not any("$$" in (r.text or "") for r in got)
    assert sum(r.text == good[0] for r in got) == 3 and quality.drop_poor(docs(spark, []), labels).count() == 0


def test_every_character_run_of_a_word_is_looked_up():
    rng = random.Random(5)
    for word in ("a", "ab", "x" * 14 + "zorgwub", "q" * 32, "q" * 33, "Donaudampfschifffahrtsgesellschaft", "これは空白のない長い文です" * 9, "".join(rng.choice("abcde") for _ in range(3000))):
        data = np.frombuffer(common.folded(word), dtype=np.uint8)
        v = toxicity.Vocabulary([word])
        got = v.part(np.arange(len(v.words)))
        marked, want = [1, *data.tolist()], set()
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                acc = n
                for c in marked[i : i + n]:
                    acc = (acc * 0x100000001B3 + c) & common.MASK64
                want.add(int(common.mix64(np.array([acc], dtype=common.U64))[0]) % (toxicity.CHAR_ROWS - 1) + 1)
        assert {*got.rows.tolist()} == want and got.count.min() >= 1 and got.count.sum() == len(got.rows)
    assert len(toxicity.Vocabulary(["q" * 40, "q" * 40 + " " + "q" * 40]).words) == -(-40 // toxicity.PIECE)


def test_toxic_words_behind_others_in_a_long_one():
    rng = random.Random(6)
    bad = ["zorgwub", "vuxqekk", "wyzzyrp"]
    texts = [sentence(rng, 40) + (" " + bad[k % 3] if k % 2 else "") + " " + sentence(rng, 40) for k in range(400)]
    net = toxicity.Network().fit(texts, np.array([k % 2 for k in range(400)]))
    glued = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    probes = [sentence(rng, 30) + " " + glued(18 + k) + bad[k % 3] + " " + sentence(rng, 30) for k in range(30)]
    clean = [sentence(rng, 30) + " " + glued(25 + k) + " " + sentence(rng, 30) for k in range(30)]
    caught, wrong = (int((net.scored(x)[1] >= 0.5).sum()) for x in (probes, clean))
    assert caught >= 24 and wrong <= 6, (caught, wrong)


@pytest.mark.parametrize("n", [1, 17, 32, 33, 100, 161])
def test_passages_of_half_a_window_lie_whole_in_one(n):
    v = toxicity.Vocabulary([" ".join(f"w{k}" for k in range(n))])
    windows = [{*w.tolist()} - {0} for w in v.windows()[0]]
    runs = [{*v.places[k : k + 16].tolist()} for k in range(max(1, n - 15))]
    assert all(any(run <= w for w in windows) for run in runs)


def test_toxicity_held_out(spark):
    d, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    assert sum((r.predicted == 1) == (r.toxic == 1) for r in got) >= 0.95 * len(got)
    assert len(toxic) > 3 and sum(toxic) >= 0.8 * len(toxic)  # what is never marked as toxic would be right on most


def test_models_without_labels_and_odd_texts(spark):
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [None, "", "x", "word " * 100_000], [1, None, 3, 3])
    t = toxicity.toxicity_scores(frame, labels).collect()
    q = quality.quality_scores(frame, labels).collect()
    assert len(t) == len(q) == 4 and all(0 <= r.score <= 1 for r in [*t, *q])
    assert all(r.predicted == 0 for r in t) and all(r.predicted == 1 for r in q)
    assert toxicity.toxicity_scores(docs(spark, []), labels).count() == 0


def test_quality_held_out(spark):
    d, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum((r.predicted == 1) == (r.quality == 1) for r in got) >= 0.95 * len(got)


# --- 6 ---------------------------------------------------------------------------------------


def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path, monkeypatch):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    bodies = ["é" * 600, "é" * 600, fake * 3, None, "", "short", "short", fake + "x" * 2000, "p" * 1500, fake + "x" * 2000]
    pages = spark.createDataFrame([(i, f"http://e/{i}", b, "x") for i, b in enumerate(bodies)], "page_id long, url string, html string, path string")
    for chunk in (64, 700, 1 << 20):
        monkeypatch.setattr(warc.read_archives, "__defaults__", (chunk, False))
        got = sorted(tuple(r) for r in warc.archive_round_trip(pages, keep_at=str(tmp_path / f"w{chunk}")).collect())
        want = []
        for i, b in enumerate(bodies):
            data = (b or "").encode()
            last = max(j for j, c in enumerate(bodies) if (c or "") == (b or ""))
            again = len(data) >= 1000 and last != i
            want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
        assert [(*r[:4], r[4]) for r in got] == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_long_urls_and_broken_chains(spark, tmp_path):
    urls = ["http://e/" + "q" * 100_000, "http://e/1", "data:," + "x" * 70_000, "http://e/3"]
    pages = spark.createDataFrame([(i, u, f"body {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    got = warc.archive_round_trip(pages, keep_at=str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, 6) for i in range(4)]
    data = next((tmp_path / "w").rglob("part-*")).read_bytes()
    at = [x[0] for x in warc.candidates(data)]
    for k, broken in enumerate((data[:-3], data[: at[2]] + b"junk" + data[at[2] :], b"junk" + data, b"junk")):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / "part-0").write_bytes(broken)
        with pytest.raises(ValueError, match="records end at byte"):
            warc.read_archives(spark, str(tmp_path / f"b{k}"))


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rng = random.Random(18)
    sizes = [rng.randint(0, 300) for _ in range(300)] + [9_000] * 12 + [rng.randint(0, 300) for _ in range(100)] + [50_000, 30_000]
    pages = spark.createDataFrame([(i, "u", chr(97 + i % 26) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    got = warc.archive_round_trip(pages, keep_at=str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [*enumerate(sizes)]
    files = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert sum(n > 20_000 for n in files) == 2 and len(files) < 60


@pytest.mark.parametrize("least", [0, 100_000])
def test_warc_repeated_and_missing_ids(spark, monkeypatch, least):
    monkeypatch.setattr(common, "BROADCAST_ROWS", least)
    long = "x" * 1500
    rows = [(1, long), (2, long), (2, long), (None, long), (None, "y" * 1200), (None, "y" * 1200), (3, None), (3, "z"), (4, "y" * 999), (5, "y" * 999)]
    pages = spark.createDataFrame([(i, None, h, "d", 1, 2) for i, h in rows], "page_id long, url string, html string, digest string, bytes int, payload int")
    got = sorted(((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    assert got == sorted([
        ("1", 1500, "revisit", 2), ("2", 1500, "response", None), ("2", 1500, "response", None), ("None", 1500, "revisit", 2), ("None", 1200, "response", None),
        ("None", 1200, "response", None), ("3", 0, "response", None), ("3", 1, "response", None), ("4", 999, "response", None), ("5", 999, "response", None),
    ], key=str)


def test_warc_headers_in_time_and_as_one_by_one():
    import time

    def one(data, at):
        end = data.find(b"\r\n\r\n", at)
        fields = {m[1].lower(): m[2] for m in warc._FIELD.finditer(data, at + len(warc.MAGIC), end + 2)} if end >= 0 else {}
        return [(at, end + 4, fields)] if fields.get(b"content-length", b"").isdigit() else []

    rng = random.Random(8)
    parts = [warc.MAGIC, b"Content-Length: 2\r\n", b"WARC-Type: a\r\n", b"\r\n", b"x", b"content-length: 31\r\n"]
    for _ in range(300):
        data = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert [*warc.headers(data)] == [x for m in re.finditer(re.escape(warc.MAGIC), data) for x in one(data, m.start())]
    began = time.time()
    assert len([*warc.headers(warc.MAGIC * 200_000 + b"Content-Length: 0\r\n\r\n")]) == 200_000
    assert time.time() - began < 5


# --- 7 ---------------------------------------------------------------------------------------


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(9)
    items = [sentence(rng, n) for n in (6, 11, 20, 40, 70, 150, 300)] + ["", "!", None]
    texts = [sentence(rng, 400) + " " + items[k % 7] + " " + sentence(rng, k * 13) for k in range(30)] + [None, "", items[2], " ".join(items[:7])]
    for k in range(7):  # most of an item
        w = items[k].split()
        texts.append(sentence(rng, 50) + " " + " ".join(w[: max(5, int(len(w) * 0.9))]))
    frame = docs(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (3, items[3])], "item_id long, text string")
    want = {}
    for (i, t), (j, q) in product(enumerate(texts), enumerate(items)):
        if len((q or "").split()) >= 5 and len((t or "").split()) >= 5:
            a, b = set(common.shingles(t).tolist()), set(common.shingles(q).tolist())
            if len(a & b) >= 0.8 * len(b) - 1e-9:
                want[i, j] = (len(a & b), len(b))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontam.contained_items(frame, bench).collect()}
    assert got == want
    assert decontam.contained_items(frame, bench.limit(0)).count() == 0 and decontam.contained_items(docs(spark, []), bench).count() == 0


def brute_contained(texts, items):
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for j, q in enumerate(items):
        words = (q or "").lower().split()
        n = min(5, len(words))
        own = grams(words, n) if n else set()
        out |= {(i, j) for i, t in enumerate(texts) if own and len(own & grams((t or "").lower().split(), n)) >= 0.8 * len(own) - 1e-9}
    return out


@pytest.mark.parametrize("at_once", [1 << 15, 64])
def test_items_of_any_length_in_documents_of_any_length(spark, monkeypatch, at_once):
    monkeypatch.setattr(decontam, "AT_ONCE", at_once)  # 64: nearly all documents are read in stretches
    monkeypatch.setattr(common, "HOT", 1)
    rng = random.Random(14)
    items = ["one two three", "Uno dos", "solo", "a b c d", sentence(rng, 7), sentence(rng, 33), sentence(rng, 100), sentence(rng, 400), "", None]
    texts = [sentence(rng, 300) + f" {q or ''} " + sentence(rng, 2000 if k % 2 else 30) for k, q in enumerate(items)]
    texts += ["one two three", "two three", "one two four three", "solo", "", None, "a b c", "x a b c d", " ".join(q or "" for q in items)]
    want = brute_contained(texts, items)
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.contained_items(docs(spark, texts), bench).collect()]
    assert len(got) == len(want) and set(got) == want


def test_short_words_of_a_very_long_document(spark):
    rng = random.Random(15)
    item = sentence(rng, 60)
    long = "word " * 300_000 + item + " word" * 100_000
    frame, bench = docs(spark, [long, long + "x", "z" * 700_000 + " " + item]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contained_items(frame, bench).collect()) == [0, 1, 2]


@pytest.mark.parametrize("least", [0, 100_000])
def test_contaminated_rows_go_by_id_and_text(spark, monkeypatch, least):
    monkeypatch.setattr(common, "BROADCAST_ROWS", least)
    rng = random.Random(16)
    item = sentence(rng, 20)
    rows = [(1, "a clean text"), (7, f"x {item} y"), (7, "b is clean"), (None, "x"), (None, "y"), (None, f"{item} z"), (None, None), (7, f"x {item} y")]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = decontam.drop_contaminated(frame, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "a clean text"), ("7", "b is clean"), ("None", "None"), ("None", "x"), ("None", "y")]
    assert kept.columns == frame.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.drop_contaminated(frame, none).count() == 8 and decontam.drop_contaminated(docs(spark, []), none).count() == 0


def test_short_and_repetitive_items_are_never_missed(spark):
    rng = random.Random(12)
    items = [sentence(rng, 5 + k % 8) for k in range(120)] + ["again and again " * 6, "one two three four five six " * 4 + "seven", "no no no no no no no no no no no no no"]
    texts = [sentence(rng, 60) + " " + " ".join(q.split()[: len(q.split()) - k % 2]) + " " + sentence(rng, 60) for k, q in enumerate(items)] + [" ".join(items)]
    sets = [set(common.shingles(t).tolist()) for t in texts]
    want = set()
    for j, q in enumerate(items):
        own = set(common.shingles(q).tolist())
        want |= {(i, j) for i, s in enumerate(sets) if len(own & s) >= 0.8 * len(own) - 1e-9}
    for least in (0, 100):  # short items alone, and among long ones
        more = [(1000 + k, sentence(rng, 40)) for k in range(least)]
        bench = spark.createDataFrame([*enumerate(items), *more], "item_id long, text string")
        got = [(r.doc_id, r.item_id) for r in decontam.contained_items(docs(spark, texts), bench).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("n", range(1, 10))
@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_keys_of_short_items_meet_every_match(n, threshold):
    values = np.arange(100, 100 + n, dtype=common.U64)
    size, keys = decontam.item_keys(values[: min(n, 8)], threshold)
    assert size == decontam.BY_SHINGLES
    own = values[: min(n, 8)]
    for k in range(1, len(own) + 1):
        for part in combinations(own.tolist(), k):
            if k >= threshold * len(own) - 1e-9:
                assert np.isin(decontam.shingle_keys(np.array(part, dtype=common.U64)), keys).any()


# --- 8 and 10 --------------------------------------------------------------------------------


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo<|im_end|>"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 0, "eve", "x"), (None, 0, "eve", "x"), (3, None, " ", "t"), (3, 20_000, "zed", "far")]
    got = chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.participant, r.part): r for r in got}
    assert sum(r.conv_id is None for r in got) == 2 and not any(r.conv_id == 2 for r in got)
    a = by[1, "ann", 0]
    assert a.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo< |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    spans = [a.rendered[int(x) : int(y)] for x, y in (s.split(":") for s in a.mask.split(","))]
    assert spans == ["hi<|im_end|>", "<|im_end|>"] and a.mask_chars == sum(map(len, spans))
    assert by[1, "bob", 0].n_own == 1 and by[3, "zed", 1].n_own == 1 and by[3, "zed", 0].mask == ""
    assert (3, "unknown", 0) in by


def test_long_dialogues_names_and_other_columns(spark):
    turns = [(1, k, f"s{k % 3}", f"t{k}", 9, "x") for k in range(2000)] + [(2, 0, "bob\n<|im_end|>", "hi", 9, "x"), (2, 1, "amy", "yo", 9, "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part int, participant string")
    by = {(r.conv_id, r.participant): r for r in chat.rotate_perspectives(frame).collect()}
    assert len(by) == 5
    for me in ("s0", "s1", "s2"):
        text, spans = "", []
        for _, k, who, t, *_ in turns[:2000]:
            text += "<|im_start|>assistant\n" if who == me else f"<|im_start|>user name={who}\n"
            if who == me:
                spans.append(f"{len(text)}:{len(text) + len(t) + 10}")
            text += t + "<|im_end|>\n"
        assert (by[1, me].rendered, by[1, me].mask, by[1, me].n_turns, by[1, me].part) == (text, ",".join(spans), 2000, 0)
    assert by[2, "amy"].rendered == "<|im_start|>user name=bob < |im_end|>\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert chat.rotate_perspectives(frame.limit(0)).count() == 0


def wrapped(text, width):
    import textwrap

    return "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))


def test_licenses(spark):
    mit = KNOWN_LICENSES["MIT"][0]
    texts = [mit, "MIT License\n\nCopyright (c) 2020 A\nCopyright 2021 B\n\n" + mit.upper().replace("SUBLICENSE", "sub-license"), mit + " extra", None, "", "All rights reserved.\n" + mit.replace(" ", "\n"), mit + " " * 2_000_000, mit]
    got = licenses.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == ["MIT", "MIT", None, None, None, "MIT", "MIT", "MIT"]
    assert all(r.canonical_sha256 == hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest() for r, t in zip(got, texts, strict=True))
    assert licenses.license_scan(docs(spark, [])).count() == 0


def test_licenses_however_they_are_wrapped(spark):
    every = [(name, t) for name, ts in KNOWN_LICENSES.items() for t in ts]
    texts = [head + wrapped(t, width).replace("\n", end) for name, t in every for width, end, head in ((40, "\n", ""), (72, "\r\n", "Copyright (c) 2001-2020, The Holders <a@b.c>\r\n\r\n"), (79, "\n", "Copyright 2019 X\n  © 2020 Y\nCopyright <YEAR> <HOLDER>\n"), (80, "\r", ""))]
    got = licenses.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == [name for name, _ in every for _ in range(4)]


def test_digests_are_those_of_the_published_texts():
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    folder = Path("/usr/share/common-licenses")
    if not folder.exists():
        pytest.skip("no licence texts on this machine")
    for file, name in names.items():
        text = (folder / file).read_text()
        for t in (text, "\r\n".join(text.split("\n")), text.upper()):
            assert licenses.known_digests()[hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest()] == name


def test_license_query_finds_planted_texts(spark, duck, tmp_path):
    """The query and its SQL on documents of which some are whole licences."""
    texts = [wrapped(ts[0], 79) for ts in KNOWN_LICENSES.values()] + ["Copyright (c) 2020 A\n" + KNOWN_LICENSES["ISC"][0], "no licence", None, "MIT"]
    path = str(tmp_path / "documents.parquet")
    docs(spark, texts).write.parquet(path)
    got = queries.op10_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT doc_id, canonical_sha256, canonical_chars, license_id, matched FROM ({queries.ORACLES['op10_license_scan']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got] == want and sum(r.matched for r in got) == len(KNOWN_LICENSES) + 1


# --- queries ---------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    result = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    d, labels, bench = (common.table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality.quality_scores(d, labels).where("predicted = 1").collect()}
    left = {r.doc_id: r.text for r in d.collect() if r.doc_id in good}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    ids = sorted(first.values())
    _, root = brute_links([left[i] for i in ids])
    ids = [i for k, i in enumerate(ids) if root[k] == k]
    items = [set(common.shingles(r.text).tolist()) for r in bench.collect()]
    ids = [i for i in ids if not any(len(q & set(common.shingles(left[i]).tolist())) >= 0.8 * len(q) - 1e-9 for q in items)]
    assert sorted(got) == ids
