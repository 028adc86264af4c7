"""Each operator against brute force or a round trip, and on odd rows."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import ann, langid, licenses, lm, mixing, neardup, packing, pii, quality, rules
from tidewire.llm.common import Tables, shared_dir

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, kept string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{rng.integers(400)}" for _ in range(n)]


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with results."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:60] + words(2, 60)
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(near), "en", "b"), (4, " ".join(far), "de", "b"), (5, None, "en", "a"), (6, "", None, None),
        (7, " \t\n ", "de", None), (8, " ".join(words(3, 30_000)), "en", "a"), (9, "UPPER upper Upper", "fr", "c"), (9, "UPPER upper Upper", "fr", "c"), (None, " ".join(base), None, "a"),
        (10, "x" * 50_000, "en", "c"), (11, "ünïcode — ” 日本語   tail", "fr", None), (12, "same line\nsame line\n\nsame line", "en", "b"),
        (13, "mail a.b@c.example.com or +1 (408) 555-7710, ip 1.2.3.4.5 card 4111 1111 1111 1111", "en", "b"), (14, "a  b   c <|endoftext|> \n d ", "en", "b"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "x", None, "y") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(1, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


# ---- near duplicates ----


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_on_odd_rows(odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    want = brute_components([(i, t) for i, t, *_ in odd_rows() if i is not None])
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_duplicates_of_chains_and_lost_originals(spark):
    """Near copies of one text that are linked in part only: components equal those of all pairs."""
    rng = np.random.default_rng(4)
    base = words(9, 90)
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.choice(90, rng.integers(1, 6), replace=False):
            w[k] = f"n{rng.integers(10**6)}"
        rows.append((i * 3, " ".join(w)))
    rows += [(1000 + i, " ".join(words(100 + i, 40) + base[:70])) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_write_few_files(spark):
    """Tables of ids take few files, however many partitions a shuffle has and though nothing merges them."""
    rng, base = np.random.default_rng(6), words(5, 60)
    rows = [(i, " ".join([*base[: 60 - int(rng.integers(0, 12))], *words(200 + i, int(rng.integers(0, 25)))])) for i in range(60)]
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, top = {k: spark.conf.get(k) for k in held}, Path(shared_dir(spark).removeprefix("file:"), "tidewire")
    old = set(top.glob("neardup-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    (run,) = set(top.glob("neardup-*")) - old
    files = {t.name: len(list(t.glob("part-*"))) for t in run.iterdir()}
    ids = {name: n for name, n in files.items() if name.split("-")[1] in ("survivors", "links", "edges", "labels", "rest", "homes", "crowds", "components")}
    assert len(ids) >= 12 and max(ids.values()) <= 48 // neardup.GATHER, files


def test_blocks_compare_each_pair_once():
    side = np.array([-1, -1, 1, 1])
    assert [list(neardup._others(i, np.arange(4), side)) for i in (0, 1)] == [[2, 3], [2, 3]]
    assert list(neardup._others(1, np.arange(4), np.zeros(4, int))) == [2, 3]


def test_posterior_bounds_keep_true_links():
    for n, least in neardup.least_matches(0.75, 1e-5):
        assert sum(math.comb(n, m) * 0.75**m * 0.25 ** (n - m) for m in range(least)) < 1e-4


# ---- packing ----


def test_packing_round_trip(odd):
    got = packing.pack(odd, tokenizer=TOKENIZER).toPandas()
    t = Tokenizer.from_file(TOKENIZER)
    for i, text, *_ in odd_rows():
        if i in (None, 9):
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.piece) == list(range(len(mine)))
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
        assert (mine.length.iloc[1:] == 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


@pytest.mark.parametrize("seed", range(5))
def test_fullest_is_the_best_subset_sum(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 40, 5)}
    room = int(rng.integers(10, 90))
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    used = packing.fullest(counts, room)
    assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)
    assert all(v <= counts[k] for k, v in used.items())


def test_plan_places_every_piece_once():
    counts = {2048: 7, 2000: 3, 1024: 5, 48: 3, 1: 100}
    total = Counter()
    for used, times in packing.plan(counts, 2048):
        assert sum(k * n for k, n in used.items()) <= 2048
        total.update({k: n * times for k, n in used.items()})
    assert total == counts


# ---- mixing ----


def test_mixing_comes_near_targets_and_agrees(odd):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(odd_rows()) and (got.taken <= 2 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len(WORD.findall(t or "")) for _, t, *_ in odd_rows())
    again = mixing.mix(odd.repartition(5)).toPandas()
    assert sorted(got.fillna(-1).itertuples(index=False)) == sorted(again.fillna(-1).itertuples(index=False))


@pytest.mark.parametrize("seats,shares", [(10, [53, 24, 23]), (7, [1, 1, 1]), (100, [3.2, 0, 11, 0.5]), (3, [0, 0])])
def test_sainte_lague(spark, seats, shares):
    df = spark.createDataFrame([(i, float(s), seats) for i, s in enumerate(shares)], "k int, share double, seats long")
    got = {r["k"]: r["quota"] for r in mixing.sainte_lague(df, [], ["k"], "share", "seats").collect()}
    want = Counter()
    for _ in range(seats if sum(shares) else 0):
        want[max(range(len(shares)), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))] += 1
    assert got == {i: want[i] for i in range(len(shares))}


def test_mixed_documents_hold_the_words_taken(odd):
    taken = mixing.mix(odd).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == taken


# ---- quality classifier, language, LM ----


def test_quality_learns_and_answers_all(spark, odd, labels):
    got = quality.classify(odd, labels).toPandas()
    assert len(got) == len(odd_rows()) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert got[got.doc_id == 1].held_out.iloc[0] == (zlib.crc32(b"1") % 5 == 0)
    docs = spark.createDataFrame([(i, " ".join((["good", "clean"] if i % 2 else ["spam###", "junk&&&"]) + words(i, 20))) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    held = quality.classify(docs, marks).filter("held_out").toPandas()
    assert (held.predicted == held.doc_id % 2).mean() > 0.95


def test_language_by_profiles(spark, odd):
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert len(got) == len({i for i, *_ in odd_rows()})
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (5, 6, 7))
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", "fr", "und"}


def test_ranked_grams_match_plain_counts():
    text = "Ab ba, abba! éa 日本"
    want = Counter()
    for w in re.sub(r"[^\w]|\d|_", " ", text.lower()).split():
        s = f" {w} "
        want.update(w)
        want.update(s[i : i + 2] for i in range(len(s) - 1))
        want.update(s[i : i + 3] for i in range(len(s) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    order = [code(g) for g in sorted(want, key=lambda g: (-want[g], code(g)))]
    assert list(langid.ranked(text, 1000)) == order
    assert dict(zip(*(x.tolist() for x in langid._counted(langid.points(text))), strict=True)) == {code(g): n for g, n in want.items()}


def test_lm_base_is_exact(odd):
    got = lm.score(odd).toPandas()
    rows = [(i, (t or "").encode().lower().split()) for i, t, *_ in odd_rows()]
    train = Counter()
    for i, w in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            train.update([*w, None])
    n, v = sum(train.values()), len(train)
    base = {i: sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]) for i, w in rows if i is not None}
    known = {i: sum(train[x] > 0 for x in [*w, None]) for i, w in rows if i is not None}
    assert len(got) == len(rows) and (got.train_tokens == n).all() and (got.score <= 0).all()
    for r in got[got.doc_id.notna()].itertuples():
        assert r.base_score == pytest.approx(base[r.doc_id], rel=1e-9) and r.n_known == known[r.doc_id]


def test_filter_gives_counts_back(spark):
    rng = np.random.default_rng(1)
    keys, c = rng.integers(1, 1 << 62, 3000), rng.integers(1, 60, 3000)
    f = lm.build(spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, c, strict=True)], "key long, c long"), 1 << 20, 1.5)
    got = f.counts(keys.view(np.uint64))
    floor = lm.levels(1.5)
    near = np.abs(np.searchsorted(floor, got, side="right") - np.searchsorted(floor, c, side="right"))
    assert (near == 0).mean() > 0.97 and (got > 0).all()
    assert (f.counts(rng.integers(1, 1 << 62, 3000).view(np.uint64)) > 0).mean() < 0.02


def test_filter_grows_at_one_error_rate(spark):
    texts = lambda n: spark.createDataFrame([(" ".join(words(i, 200)).encode(),) for i in range(n)], "__bytes binary")
    sizes = []
    for n in (50, 400):
        made, edge = lm.segments(texts(n), segment=20_000)
        rows = made.collect()
        assert len(rows) == len(edge) + 1
        assert all(lm.Filter(np.frombuffer(r["bits"], np.uint8), 1.5).false_rate() < 0.02 for r in rows)
        assert all(0 <= len(r["bits"]) * 8 - 12 * r["entries"] < 8 for r in rows)
        sizes.append(len(rows))
    assert sizes[1] > 4 * sizes[0]


def test_scores_do_not_depend_on_segments(spark, odd):
    key = ["n_tokens", "base_score"]
    one, many = (lm.score(odd, segment=s).toPandas().sort_values(key) for s in (1 << 24, 3000))
    assert many.base_score.to_numpy() == pytest.approx(one.base_score.to_numpy(), rel=1e-9)
    assert (np.abs(many.score.to_numpy() - one.score.to_numpy()) / one.n_tokens.to_numpy()).mean() < 0.02


def test_lm_learns_pairs_seen_once(spark):
    docs = [(i, " ".join(words(i, 40))) for i in range(60)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    split = {i: ["<", *t.split(), ">"] for i, t in docs}
    train = [w for i, w in split.items() if zlib.crc32(str(i).encode()) % 10]
    ones, twos = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(w, w[1:], strict=False))
    assert sum(c == 1 for c in twos.values()) > 0.9 * len(twos)
    total, distinct = sum(ones.values()) - len(train), len(ones) - 1
    floor, middle = lm.levels(1.5), lm.Filter(np.zeros(1, np.uint8), 1.5).middle
    read = lambda c: float(middle[np.searchsorted(floor, c, side="right")])
    for i, w in split.items():
        want = 0.0
        for h, x in zip(w, w[1:], strict=False):
            own, before = (read(ones[x]) + 0.1) / (total + 0.1 * (distinct + 1)), read(ones[h])
            want += math.log10((min(read(twos[h, x]), before) + 300 * own) / (before + 300))
        assert got[i]["score"] / (len(w) - 1) == pytest.approx(want / (len(w) - 1), abs=0.03)


# ---- personal data ----

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, *m.span()))
    return out


@pytest.mark.parametrize(
    "text",
    ["a@b a@b.c@d.e x..y@z-.q", "@@a@b.c.", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111-1111 1111-1111 4111111111111112 1 2", "+1 (408) 555-7710 +12 +1-----2 ++4912345678", "é日 a@b.de 日 4012888888881881", ""],
)
def test_base_equals_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_spans(text))


def test_windows_decode_like_whole_texts():
    field = pii.train()
    texts = [" ".join([*words(i, 40), "tel", "030", "123", "45", "67", *words(i + 50, 30), "info[at]example.de", *words(i, 8)]) for i in range(20)] + [x for x in pii.EXAMPLES.splitlines()]
    assert pii.find(texts, field) == pii.find(texts, field, whole=True)
    assert any(k == 3 for _, added in pii.find(texts, field) for k, _, _ in added)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores, pairs = rng.normal(size=(3, 4, pii.L)), rng.normal(size=(pii.L, pii.L))
    got = pii.viterbi(scores, np.array([4, 3, 1]), pairs)
    for s, n, path in zip(scores, (4, 3, 1), got, strict=True):
        total = lambda p: pairs[0, p[0]] + sum(s[t, p[t]] for t in range(n)) + sum(pairs[a, b] for a, b in zip(p, p[1:], strict=False)) + pairs[p[-1], 0]  # noqa: B023, E731
        best = max(np.ndindex(*[pii.L] * n), key=total)
        assert list(path[:n]) == list(best)


def test_personal_data_on_odd_rows(odd):
    got = {r["doc_id"]: r for r in pii.personal_data(odd).collect()}
    r = got[13]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert got[5]["spans"] == "" and got[8]["spans"] == ""
    out = pii.redacted(odd)
    assert out.columns == odd.columns
    text = {x["doc_id"]: x["text"] for x in out.collect()}
    assert text[13].startswith("mail [EMAIL] or [PHONE], ip [IP].5 card [CARD]") and text[5] is None


# ---- rules ----


def test_rule_counts(odd, labels):
    got = rules.judged(odd, labels).toPandas()
    assert len(got) == len(odd_rows())
    for i, text, *_ in odd_rows():
        if i in (None, 9):
            continue
        text, r = text or "", got[got.doc_id == i].iloc[0]
        w = WORD.findall(text)
        tri = list(zip(w, w[1:], w[2:], strict=False))
        n, held = Counter(tri), set()
        for k, x in enumerate(tri):
            held |= {k, k + 1, k + 2} if n[x] > 1 else set()
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held))
        assert r.base_failed == (len(w) < 50 or 2 * len(held) > len(w)) and not (r.base_failed and r.kept)


def test_binomial_tail_bounds_the_exact_one(spark):
    cases = [(0, 300), (2, 1000), (9, 5000), (300, 100_000), (5, 5), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long").repartition(1)
    for r in df.select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.004).alias("t")).collect():
        exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.004) + (r.n - j) * math.log1p(-0.004)) for j in range(r.k + 1))
        assert exact * (1 - 1e-9) <= r.t <= max(exact * 1.0001, 1.0 if r.k >= r.n * 0.004 else 0)


def test_cutoffs_hold_their_bound(spark):
    """Of good documents few are rejected, and clear junk is."""
    rows = [(i, " ".join(words(i, 80) if i % 4 else [w + "###" for w in words(i, 80)]), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(4000)], "doc_id long, quality int")
    got = rules.judged(docs, marks).toPandas()
    good = got.doc_id % 4 > 0
    assert got[good].kept.mean() > 0.98 and got[~good].kept.mean() < 0.02


# ---- nearest neighbours, licences ----


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [math.nan] + [1.0] * 15), (5300, [1.0] * 3), (None, [1.0] * 16), (5400, [None] + [1.0] * 15)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 100)) and set(got.vec_id) <= set(range(1500))
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id], rtol=1e-12)
        hit += len(set(best) & set(g.vec_id))
        if q == 0:
            assert list(g.sort_values("rank").vec_id) == list(range(700, 710))
    assert hit / len(got) >= 0.9
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_licences_and_inheritance(spark):
    files = [
        ("p/LICENSE", "Released under the MIT License."), ("p/a.py", "code"), ("p/q/b.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("p/q/r/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("p/q/r/s/c.py", None), ("z/d.py", ""), (None, "x"), ("top.py", "the license of a driver is needed to drive a car in the city today"), ("p/a.py", "code"),
    ]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()
    by = {r["path"]: r for r in got}
    assert len(got) == len(files)
    assert [by[p]["effective"] for p, _ in files] == ["MIT", "MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0", None, None, None, "MIT"]
    assert by["p/q/b.py"]["inherited"] == "MIT" and by["p/q/r/s/c.py"]["from_dir"] == "p/q/r"


def test_cosines_match_plain_python(spark):
    text = "licensed under the apache license"
    idf, table, unknown = licenses.weights()
    bag = Counter(text.split())
    norm = math.sqrt(sum((n * idf.get(t, unknown)) ** 2 for t, n in bag.items()))
    want = max(sum(n * idf[t] * table[t][i] for t, n in bag.items() if t in idf) / norm for i in range(len(licenses.TEMPLATES)))
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(licenses._best(licenses.terms_of(F.col("t"))).alias("b")).first()["b"]["score"] == pytest.approx(want)


# ---- all of them ----


def test_empty_tables(spark, none):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        licenses.scan_documents(none), packing.pack(none, tokenizer=TOKENIZER), mixing.mix(none), quality.classify(none, marks), neardup.near_duplicates(none),
        pii.personal_data(none), rules.judged(none, marks), lm.score(none), langid.identify(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_licences_of_odd_rows(odd):
    assert licenses.scan_documents(odd).count() == len(odd_rows())


def test_tables_are_durable_and_go(spark):
    t = Tables(spark, "test")
    df = t.keep(spark.range(5), "five")
    assert df.count() == 5
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").replace("file:", "")
    t.drop(df)
    import os

    assert not os.path.exists(folder)


# ---- long texts, brute force on small tables ----


def test_a_long_sentence_that_names_a_licence(spark):
    long = " ".join(words(5, 20_000)) + " released under the mit license"
    rows = [("a/LICENSE", "Released under the MIT license. " + " ".join(words(6, 30))), ("a/b/c.txt", long), ("a/b/d.txt", "plain words")]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"]["licence"] == "MIT" and got["a/b/c.txt"]["licence"] is None
    assert got["a/b/d.txt"]["effective"] == "MIT" and got["a/b/d.txt"]["from_dir"] == "a"


def test_documents_inherit_from_directories_above(spark):
    rows = [(10_100, "Released under the MIT license. More words follow.", "en", "s"), (10_205, "Plain words only.", "en", "s"), (20_005, "Plain words only.", "en", "s")]
    got = {r["doc_id"]: r for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[10_100]["path"] == "s/en/1/10100" and got[10_205]["path"] == "s/en/1/102/10205"
    assert got[10_205]["inherited"] == "MIT" and got[10_205]["from_dir"] == "s/en/1" and got[20_005]["inherited"] is None


def test_ranked_byte_pairs_are_the_tokenizer():
    made, model = packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert made.fast is not None
    points = [chr(c) for c in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x110000, 97)]]
    texts = ["|".join(f"a{c}1 {c}{c}b {c} 2{c}" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    texts += ["", " ", "a  b   c <|endoftext|> d", "<|endoftext|>", "x\n\n y\t z ", "it's we'll I'VE 'S", "x" * 5000]
    for t in texts:
        assert made.ids(t) == np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_rows_without_id_spread_over_shards(spark):
    rows = [(None, " ".join(words(i, 60)), "s") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=1000, carry=("text",))
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 400 * 60, rel=0.02)
    order = mixing.seeded(17, F.lit(None), F.md5(F.col("text").cast("binary")))
    assert spark.createDataFrame(rows, "doc_id long, text string, source string").select(order.alias("o")).distinct().count() == 400


HIDDEN = """
please contact {email|r.stone (at) mail.example} soon
my mail is {email|eva [at] post [dot] example} if needed
mail {email|kim[at]office.example} any day
reach me under {email|ann (at) web (dot) org} tonight
call {phone|555-014-2288} after lunch
tel {phone|030 765 43 21} until five
phone {phone|(555) 019-4410} for help
fax {phone|555.014.7733} is off
host {ip|10-2-3-44} went down
server {ip|172-20-9-8} is slow
login from {ip|198[.]51[.]100[.]7} was seen
card {card|5555 5555 5555 4444} was charged
the card {card|4000-0566-5566-5556} is new
"""
CLEAN = """
in 1987 and 2011 the town had 14,200 people
on 2023-04-18 at 11:45 we met again
version 2.10.7 came out after 3.1
he paid 19.95 for 12 of them
isbn 978-0-306-40615-7 is a book
chapter 4 page 210 line 9
it was (at the time) fine and [dot] so on
about 60 % of 4200 rows were read
order 5512873 of 14 items is late
"""


def test_the_field_finds_hidden_spans():
    field, want, got = pii.train(), set(), set()
    for n, line in enumerate((HIDDEN + CLEAN).strip().splitlines()):
        text, at = "", 0
        for m in pii._MARK.finditer(line):
            text += line[at : m.start()]
            want.add((n, pii.KINDS.index(m[1]), len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        base, added = pii.find([text + line[at:]], field)[0]
        got |= {(n, *s) for s in base + added}
    assert len(got & want) / len(want) >= 0.8 and len(got & want) / len(got) >= 0.9


def test_scores_are_sparse_dot_products(spark, odd, labels):
    weights, intercept = quality.fit(odd, labels)
    got = {r["doc_id"]: r["score"] for r in quality.classify(odd, labels).collect()}
    for i, text, *_ in odd_rows():
        if i is not None:
            index, value = quality.features((text or "").encode())
            assert got[i] == pytest.approx(1 / (1 + math.exp(-(float(weights[index] @ value) + intercept))), abs=1e-6)


def test_ftrl_steps_match_plain_python():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4).astype(np.float32), int(rng.integers(2))) for _ in range(30)]
    alpha, beta, l1, l2, bits = 2.0, 1.0, 1e-4, 1e-3, 4
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda i: 0.0 if abs(z[i]) <= l1 * (i < 16) else (math.copysign(l1 * (i < 16), z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for epoch in range(3):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            x = dict(zip([*rows[at][0].tolist(), 16], [*map(float, rows[at][1]), 0.2], strict=True))
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - rows[at][2]) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    w, b = quality.train(rows, bits=bits, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert w.tolist() == pytest.approx([weight(i) for i in range(16)], abs=1e-5) and b == pytest.approx(0.2 * weight(16), abs=1e-5)


def test_nearest_neighbours_over_many_cells(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 16)) + 4 * rng.normal(size=(20, 16))[rng.integers(20, size=4000)]
    x[100:400] = x[100]  # one vector three hundred times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[200].tolist()), (4000, None), (4100, [0.0] * 16)], "vec_id long, embedding array<double>")
    got = ann.search(df, cell=300, part=150, block=8, again=40).toPandas()
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(4000) if i != q)[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and mine.score.is_monotonic_increasing
        hits += len({i for _, i in want} & set(mine.vec_id))
    assert hits >= 0.95 * 400
    assert sorted(set(got[got.query_id == 100].vec_id))[:3] == [101, 102, 103]


def test_out_of_place_distance_matches_plain_python(spark):
    lists = {"a": langid.ranked("the cat and the dog in the house", 40), "b": langid.ranked("der hund und die katze in dem haus", 40)}
    known = langid.Profiles(lists, 40)
    for text in ("the dog", "die katze", "house haus", "q"):
        own = langid.ranked(text, 40).tolist()
        apart = {x: sum(abs(p.tolist().index(g) - i) if g in p else 40 for i, g in enumerate(own)) for x, p in lists.items()}
        best = min(sorted(apart), key=apart.get)
        assert known.nearest(text) == (best, pytest.approx(1 - apart[best] / (40 * len(own))))
