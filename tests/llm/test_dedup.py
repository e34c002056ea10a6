"""Exact dedup, n-gram Jaccard join and substring dedup against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower, text_bytes
from cohortlens.llm.components import components
from cohortlens.llm.exact_dedup import exact_dedup
from cohortlens.llm.ngram_join import PRODUCT_BLOCKS, band, column_blocks, ngram_jaccard_join
from cohortlens.llm import substring_dedup as substring
from cohortlens.llm.substring_dedup import MIN_SENTENCES, MIN_WORDS, SENTENCE_WORDS, substring_dedup
from tests.llm.fixtures import CLASHES, FOLD, edge_texts, frame, words_of


def test_ascii_lower_leaves_other_letters(spark):
    row = spark.createDataFrame([("ÀÉİ ABCXYZ",)], "t string").select(ascii_lower(F.col("t"))).first()
    assert row[0] == "ÀÉİ abcxyz"


def test_exact_dedup_keeps_the_largest_id_of_equal_texts(spark):
    rows = edge_texts()
    got = exact_dedup(frame(spark, rows))
    assert [c for c in got.columns if c in CLASHES and c != "kept"] == [c for c in CLASHES if c != "kept"]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    want = sorted((i, max(groups[(t or "").translate(FOLD)]), len(groups[(t or "").translate(FOLD)])) for i, t in rows)
    out = got.collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_exact_dedup_same_length_and_prefix(spark):
    """Equal length and prefix but other text, and equal text in other case, at every refinement level."""
    head = "x" * 80
    rows = [(1, head + "a"), (2, head + "b"), (3, head.upper() + "A"), (4, "y" * 81), (5, None), (6, "")]
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True), 5: (6, False), 6: (6, True)}


def test_exact_dedup_heavy_groups_and_clashing_columns(spark):
    # one group of half the rows is broadcast, pairs meet by shuffle, single rows are excluded by length or prefix
    texts = ["The SAME text"] * 60 + [f"pair {i // 2:03d}" for i in range(40)] + ["x" * i for i in range(20, 60)]
    rows = [(i, t.upper() if i % 2 else t, i * 7, "bits") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha long, _bits string")
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t.lower(), []).append(i)
    for members in groups.values():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
            assert (got[i].text, got[i]._sha, got[i]._bits) == (rows[i][1], i * 7, "bits")
    assert len(got) == len(rows)


def test_exact_dedup_null_ids_and_empty_table(spark):
    rows = [(None, "t"), (1, "t"), (None, "only")]
    got = {(r.doc_id, r.text): (r.keep_id, r.kept) for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {(None, "t"): (1, False), (1, "t"): (1, True), (None, "only"): (None, True)}
    assert exact_dedup(frame(spark, [])).count() == 0


def shingles(text, k):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, k)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_ngram_join_equals_all_pairs(spark, k, num, den):
    rows = edge_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, rows), k=k, num=num, den=den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_ngram_join_of_a_family_without_its_base(spark):
    """Many near copies around the threshold whose common base is not in the table, and sizes at the band borders."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(80):
        w = list(base[: rng.randint(78, 90)])
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + n, " ".join(f"q{i}" for i in range(n))) for n in range(1, 60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_size_bands_of_linked_sizes_are_neighbours():
    n = np.arange(1, 3000)
    for m in n[::7]:
        linked = n[(10 * np.minimum(n, m) >= 9 * np.maximum(n, m))]
        assert (abs(band(linked, 9, 10) - band(np.array([m]), 9, 10)) <= 1).all()


def test_blocks_of_the_product_cover_every_column_once():
    own = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 500, dtype=np.uint64))
    parts = column_blocks(own)
    assert len(parts) == PRODUCT_BLOCKS and min(map(len, parts)) > 0
    assert sorted(np.concatenate(parts).view(np.uint64)) == sorted(own)
    assert [len(p) for p in column_blocks(own[:0])] == [0] * PRODUCT_BLOCKS


def test_ngram_join_empty_table_and_null_ids(spark):
    assert ngram_jaccard_join(frame(spark, [])).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (None, "x y z"), (4, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (None, 1, None), (4, 0, 4)], key=str)


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(10, 70)] + [(100 + i, 500) for i in range(40)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 10 for i in range(10, 71)}, **{100 + i: 100 for i in range(40)}, 500: 100}


OPENS_NO_WORD = "\u3000\u3001\u3002\u3003\u3009\u300b\u300d\u300f\u3011\u3015"
ENDS, CLOSERS = ".!?؟۔…।॥。！？．｡", "\"')]}»”’›」』）】》〉〕｣"


def naive_sentences(text):
    """(start, end, lower-cased word) of every word, and the word numbers of every sentence."""
    ws = []
    for m in re.finditer(r"[^\x20\t-\r]+", text):
        at = m.start()
        for k in range(m.start() + 1, m.end() + 1):
            if k == m.end() or (0x3000 <= ord(text[k]) <= 0x9FFF and text[k] not in OPENS_NO_WORD):
                ws.append((at, k, text[at:k].translate(FOLD)))
                at = k
    n = len(ws)
    if not n:
        return ws, []
    data, offsets = text_bytes(pa.array([text]))
    h = substring.words(data, offsets, substring._WORD, substring.script_words(data))[0]
    assert len(h) == n
    value = [2**64 - 1] + [int(substring.mix(h[k - 1 : k] * np.uint64(0x9FB21C651E98DF25) + h[k : k + 1])[0]) for k in range(1, n)]

    def closes(k):
        word = ws[k][2]
        while word and word[-1] not in ENDS and word[-1] in CLOSERS:
            word = word[:-1]
        return bool(word) and word[-1] in ENDS

    cuts = [k for k in range(n) if not k or closes(k - 1) or "\n" in text[ws[k - 1][1] : ws[k][0]]]
    more = set(cuts)
    for a, e in zip(cuts, [*cuts[1:], n], strict=True):
        if e - a > substring.CUT_ABOVE:  # places whose hash is the least around
            for k in range(a, e):
                before = value[max(0, k - substring.REACH) : k]
                behind = value[k + 1 : k + 1 + substring.REACH]
                if all(value[k] < v for v in before) and all(value[k] <= v for v in behind):
                    more.add(k)
    cuts = sorted(more)
    for a, e in zip(cuts, [*cuts[1:], n], strict=True):
        while e - a > SENTENCE_WORDS:
            part = range(a + substring.REACH, a + SENTENCE_WORDS + 1)
            a = min(part, key=lambda k: (value[k], k))
            more.add(a)
    cuts = sorted(more)
    return ws, [list(range(a, e)) for a, e in zip(cuts, [*cuts[1:], n], strict=True)]


def brute_substring(rows):
    first, out = {}, {}
    for i, text in sorted({(i, t) for i, t in rows}, key=lambda r: r[0]):
        text = text or ""
        ws, sentences = naive_sentences(text)
        n = len(sentences)
        total = [0]
        for s in sentences:
            total.append(total[-1] + len(s))
        runs = set()
        for a in range(n):
            runs.update([(a, e) for e in range(a + MIN_SENTENCES, n + 1) if total[e] - total[a] >= MIN_WORDS][:1])
        for e in range(n + 1):
            runs.update([(a, e) for a in range(e - MIN_SENTENCES, -1, -1) if total[e] - total[a] >= MIN_WORDS][:1])
        gone = set()
        for a, e in sorted(runs):
            run = tuple(w for _, _, w in ws[total[a] : total[e]])
            if run in first:
                gone.update(range(a, e))
            first.setdefault(run, i)
        starts = [ws[s[0]][0] for s in sentences] + [len(text)]
        if n:
            starts[0] = 0
        out[i] = (n, sorted(gone), "".join(text[starts[j] : starts[j + 1]] for j in range(n) if j not in gone) if gone else text)
    return out


def test_substring_dedup_equals_brute_force(spark):
    rows = [r for r in edge_texts() if r[0] != 4] + [(4, edge_texts()[3][1])]
    rows = [(i, t[:20000] if t else t) for i, t in rows]
    got = substring_dedup(frame(spark, rows))
    assert [c for c in got.columns if c in CLASHES] == CLASHES
    got = {r.doc_id: (r.n_sentences, r.removed, r.clean_text or "") for r in got.collect()}
    assert got == brute_substring(rows)
    assert all(got[i][1] for i in range(41, 45)) and not got[40][1]


def test_substring_dedup_nulls_repeated_rows_and_empty_table(spark):
    long = "This one is a sentence of nine words here. " * 6
    rows = [(1, None), (2, long), (2, long), (None, long), (3, long)]
    got = substring_dedup(frame(spark, rows)).collect()
    kept = {(r.doc_id, r.clean_text) for r in got}
    assert (1, None) in kept and len(got) == 5
    assert {r.n_removed for r in got if r.doc_id == 2} == {r.n_removed for r in got if r.doc_id is None}
    assert [r.n_removed for r in got if r.doc_id == 3] == [6]
    assert substring_dedup(frame(spark, [])).count() == 0



def test_content_cuts_find_passages_behind_other_words(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passage = " ".join(word() for _ in range(60))
    rows = [(k, " ".join(word() for _ in range(3 + 4 * k)) + " " + passage + " " + " ".join(word() for _ in range(5 + k))) for k in range(6)]
    quoted = [" ".join(word() for _ in range(11)) + mark for mark in ('."', ".)", "!”", "。", "？」")]
    rows += [(10 + k, f"{word()} {word()}\n{' '.join(quoted)} {word()} {word()}") for k in range(2)]
    kana = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(90))
    rows += [(20 + k, "".join(chr(0x3041 + rng.randrange(60)) for _ in range(7 + 5 * k)) + kana) for k in range(2)]
    inner = " ".join(word() for _ in range(24)) + "."
    rows += [(30 + k, f"{word()} {word()} " + " ".join(f"{x}{i}" for x in "ab" for i in range(14)) + f". {inner} " + " ".join(f"c{i}" for i in range(14)) + f" {word()}.") for k in range(2)]
    rows += [(40 + k, " ".join(word() for _ in range(k + 1)) + " " + "p q r s t " * 60) for k in range(2)]
    got = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    texts = dict(rows)
    for i, r in got.items():
        if i in (0, 10, 20, 30):
            assert not r.removed and r.clean_text == texts[i]
        elif i not in (40, 41):
            assert r.n_removed >= 2, i
    for i in range(1, 6):  # the words before and behind the passage stay
        kept = got[i].clean_text.split()
        assert kept[: 3 + 4 * i] == texts[i].split()[: 3 + 4 * i] and kept[-5 - i :] == texts[i].split()[-5 - i :]
    assert got[11].clean_text.count("w") <= 2 + 2 + 1
    assert len(got[41].clean_text.split()) < 60


def test_links_through_rows_without_ids_and_texts_that_share_one(spark):
    base = [f"w{i}" for i in range(200)]

    def text(changed):
        return " ".join(f"x{i}" if i in changed else w for i, w in enumerate(base))

    # the middle text links with both others, which do not link with each other
    rows = [(1, text({0, 1})), (None, text({0, 1, 50, 199})), (2, text({50, 199}) + " y")]
    alone = [(7, "some other words stand here alone"), (7, "nothing of that kind in this one"), (3, "some other words stand here alone"), (9, "nothing of that kind in this one")]
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard_join(frame(spark, rows + alone), num=9, den=10).collect()}
    want = {(i, c) for (i, _), (_, c) in zip(rows + alone, brute_rows(rows + alone, 3, 9, 10), strict=True)}
    assert got == want and (None, 1) in got and {(7, 3), (7, 7), (3, 3), (9, 7)} <= got
    none = [(None, "a b c d"), (None, "a b c d"), (None, ""), (None, None)]
    assert [r.component_id for r in ngram_jaccard_join(frame(spark, none)).collect()] == [None] * 4


def brute_rows(rows, k, num, den):
    """(set size, smallest id reachable) of every row."""
    sets = []
    for _, t in rows:
        ws = words_of(t)
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set()))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and den * len(a & b) >= num * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    ids = [[rows[j][0] for j in range(len(rows)) if group[j] == g and rows[j][0] is not None] for g in group]
    return [(len(s), min(found) if s and found else i) for s, found, (i, _) in zip(sets, ids, rows, strict=True)]
