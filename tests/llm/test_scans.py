"""Decontamination, secret scan and tool calls against brute force."""

import collections
import json
import random
import time
import re

import pytest
from pyspark.sql import types as T

from cohortlens.llm.decontamination import GRAM, SPAN, WINDOW, decontaminate, winnow
from cohortlens.llm.secret_scan import SCOPE, scan_secrets, span_text
from cohortlens.llm.tool_calls import chat_messages, link_tool_calls, topological_order, turns_as_messages
from tests.llm.fixtures import FOLD, edge_texts, frame


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_hits(docs, items):
    windows, sizes = collections.defaultdict(set), set()
    for i, t in items:
        w = bench_words(t)
        n = min(len(w), SPAN)
        if n:
            sizes.add(n)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (s := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= s
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 60)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([9, 10, 11, 14, 25, 40, 3, 2, 60, 60])]
    items += [(20, "same " * 30), (21, "same same same"), (22, None), (23, ""), (24, "..."), (25, items[5][1]), (25, items[5][1]), (26, "alone")]
    docs = [(i, t[:8000] if t else t) for i, t in edge_texts()]
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = items[rng.randrange(10)][1].split()
            a = rng.randrange(len(words))
            parts += [" ".join(word() for _ in range(rng.randint(0, 6))), "-".join(words[a : a + rng.randint(1, 30)]).upper()]
        docs.append((100 + k, " ".join(parts)))
    docs += [(300, "same " * 100), (301, "x same same y"), (302, "Alone, ALONE"), (303, items[9][1] * 3)]
    schema = T.StructType().add("item_id", "long").add("text", "string").add("key", "string")
    found = decontaminate(frame(spark, docs), spark.createDataFrame([(*r, None) for r in items], schema)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == brute_hits(docs, items)
    assert len(found) == len(docs)
    for r in found:  # the spans cover the hit words
        assert len({x for s in r.spans for x in range(s.first, s.past)}) == r.n_hit


def test_decontamination_without_items_or_documents(spark):
    docs, none = frame(spark, [(1, "a b c"), (None, "x " * 20)]), spark.createDataFrame([], "item_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_hit) for r in decontaminate(docs, none).collect()} == {(1, 3, 0), (None, 20, 0)}
    some = spark.createDataFrame([(5, "x " * 12)], "item_id long, text string")
    assert {(r.doc_id, r.n_hit) for r in decontaminate(docs, some).collect()} == {(1, 0), (None, 20)}
    assert decontaminate(frame(spark, []), some).count() == 0


def test_winnowing_keeps_a_fingerprint_of_every_span():
    import numpy as np

    h = np.random.default_rng(3).integers(0, 40, 400).astype(np.uint64)  # many ties
    kept = set(winnow(h).tolist())
    assert SPAN == WINDOW + GRAM - 1
    for k in range(len(h) - WINDOW + 1):
        least = max(j for j in range(k, k + WINDOW) if h[j] == h[k : k + WINDOW].min())
        assert least in kept


SECRETS = [
    (1, 'x password = "abcdef" Token: 12345 SECRET:=zz99zz API-KEY=q api_key=abc.def-_= apikey\' : \'ABCDEFGHIJ'),
    (2, "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15 + " AKIAAKIA" + "Z9" * 8),
    (3, "é日😀 " + "0123456789abcdef" * 2 + " deadbeef " + "a" * 23 + "G" + "b" * 24),
    (4, "token=token=abcdef secret=token = abcdefgh passwd:x"),
    (5, None),
    (6, ""),
    (7, "password=" + "f" * 30 + " " + "AKIA" + "B" * 20),
    (8, "key wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY near AKIA" + "C" * 16 + " at https://s3.example.org/x"),
    (9, "key wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY alone " + "z" * 900 + " AKIA" + "C" * 16),
    (10, "see https://example.org/a only"),
    (11, "long " * 20000 + "token=abcdefghi"),
]


def brute_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_secret_scan_base_and_links(spark):
    from pyspark.sql import functions as F

    got = scan_secrets(frame(spark, SECRETS)).select("doc_id", span_text(F.concat("assign", "access", "hex")).alias("base"), "linked").collect()
    assert {r.doc_id: r.base for r in got} == {i: brute_base(t) for i, t in SECRETS}
    linked = {r.doc_id: sorted(s.kind for s in r.linked) for r in got if r.linked}
    assert linked == {8: ["endpoint", "key40"]}
    text = dict(SECRETS)[8]
    (spans,) = [r.linked for r in got if r.doc_id == 8]
    assert {text[s.start : s.end] for s in spans} == {"wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY", "https://s3.example.org/x"}
    assert SCOPE < 900
    assert scan_secrets(frame(spark, [])).count() == 0


def test_secret_links_equal_brute_force_over_distances(spark):
    key, access = "wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY", "AKIA" + "C" * 16
    rows = [(d, f"{'x ' * (d % 7)}{key}{' ' * d}{access}") for d in range(1, 900, 37)]
    got = {r.doc_id: len(r.linked) for r in scan_secrets(frame(spark, rows)).collect()}
    assert got == {d: int(d < SCOPE) for d, _ in rows}


LINKED = "key id AKIA" + "Q" * 16 + " then " + "aB3" * 13 + "c and more"


def test_secrets_of_rows_without_an_id_or_with_equal_ids_are_their_own(spark):
    rows = [(1, LINKED), (None, LINKED), (None, "aB3" * 13 + "c alone"), (2, "AKIA" + "Q" * 16), (2, "x " + "aB3" * 13 + "c")]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, len(r.access), len(r.linked)) for r in got), key=str) == sorted(
        [(1, 1, 1), (None, 1, 1), (None, 0, 0), (2, 1, 0), (2, 0, 0)], key=str
    )


def test_time_of_a_text_with_many_spans_grows_in_proportion(spark):
    def seconds(n):
        runs = [f"{i:024x}" for i in range(n)]
        docs = spark.createDataFrame([(1, " ".join(runs))], "doc_id long, text string")
        start = time.time()
        got = scan_secrets(docs).first()
        assert [(s.start, s.end) for s in got.hex] == [(25 * i, 25 * i + 24) for i in range(n)]
        return time.time() - start

    seconds(100)
    few, many = seconds(16_000), seconds(64_000)
    assert many < 8 * few + 5


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
SCHEMAS = {"add": {"a": (("BIGINT", "DECIMAL(2,1)"), True), "b": (("BIGINT",), False)}, "say": {"text": (("STRING",), True)}}


def test_tool_calls_link_validate_and_serialise(spark):
    calls = [
        (1, 0, "x", "add", '{"b": 2, "a": 1}', []),
        (1, 2, "y", "add", '{"a": "1"}', ["x"]),
        (1, 4, "z", "add", '{"b": 2}', ["x", "none"]),
        (1, 6, "u", "say", '{"text": "q\\"é", "more": 1}', None),
        (1, 8, "v", "other", "{}", []),
        (1, 10, "w", "say", "not json", []),
        (1, 12, None, "say", None, []),
        (2, 0, "x", "say", '{ "text" : "hi" }', []),
        (2, 0, "x", "say", '{ "text" : "hi" }', []),
    ]
    results = [(1, 3, "x", "late"), (1, 1, "x", "3"), (2, 1, "x", None), (1, 9, None, "lost"), (3, 1, "x", "elsewhere")]
    got = link_tool_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), SCHEMAS
    ).collect()
    assert len(got) == len(calls)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].valid for t in range(0, 13, 2)] == [True, False, False, False, False, False, False]
    assert by[2, 0].valid and by[2, 0].answered and by[2, 0].answer_turn == 1
    assert by[1, 0].json == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","result":"3"}'
    assert json.loads(by[1, 10].json) == {"arguments": None, "id": "w", "name": "say", "result": None}
    assert json.loads(by[1, 6].json)["arguments"] == {"text": 'q"é', "more": 1}
    assert not by[1, 12].answered and by[1, 12].position == 12


def test_topological_order_moves_calls_behind_what_they_use(spark):
    rng = random.Random(2)
    ids = [f"c{i}" for i in range(14)]
    hidden = ids[:]
    rng.shuffle(hidden)
    rows = [(1, t, c, [hidden[j] for j in rng.sample(range(hidden.index(c)), min(2, hidden.index(c)))]) for t, c in enumerate(ids)]
    rows += [(2, 0, "a", ["b"]), (2, 1, "b", ["a"]), (2, 2, "c", []), (3, 0, "a", []), (3, 1, "b", ["a"])]
    got = topological_order(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>")).collect()
    place = {(r.conv_id, r.call_id): (r.position, r.bump) for r in got}
    for conv, _, c, after in rows:
        if conv != 2:
            assert all(place[conv, c] > place[conv, a] for a in after)
    assert {r.call_id for r in got if r.cyclic} == {"a", "b"} and len(got) == 19


def places(rows):
    """Places by walking: the last of a call's own turn and, behind each dependency, that one's place."""
    after = {}
    turns = {}
    for conv, turn, call, deps in rows:
        after.setdefault((conv, call), set()).update((conv, d) for d in deps)
        turns[conv, call] = min(turn, turns.get((conv, call), turn))
    after = {c: {d for d in deps if d in turns} for c, deps in after.items()}
    done = {}
    while True:
        ready = [c for c in turns if c not in done and all(d in done for d in after[c])]
        if not ready:
            return {c: (*done[c], False) if c in done else (turns[c], 0, True) for c in turns}
        for c in ready:
            done[c] = max([(turns[c], 0), *((done[d][0], done[d][1] + 1) for d in after[c])])


def ordered(spark, rows):
    got = topological_order(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>")).collect()
    out = {(r.conv_id, r.call_id): (r.position, r.bump, r.cyclic) for r in got}
    assert len(out) == len(got)
    return out


def test_topological_order_equals_walking(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(60):
        n = rng.randint(1, 14)
        for t in range(n):
            deps = rng.sample(range(n + 1), min(n, rng.choice([0, 1, 1, 1, 1, 2])))
            rows.append((conv, t, f"c{t}", [f"c{d}" for d in deps]))
    want = places(rows)
    assert ordered(spark, rows) == want
    assert len({c for _, _, c in want.values()}) == 2 and max(b for _, b, _ in want.values()) > 4


def test_a_chain_of_5000_calls_takes_few_rounds(spark):
    n = 5000
    rows = [(1, t, str(t), [str(t + 1)]) for t in range(n)] + [(1, n, str(n), [])] + [(2, t, str(t), [str((t + 1) % 300)]) for t in range(300)]
    start = time.time()
    got = ordered(spark, rows)
    assert time.time() - start < 60
    assert all(got[1, str(t)] == (n, n - t, False) for t in range(n + 1)) and all(got[2, str(t)] == (t, 0, True) for t in range(300))


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None)], [(None, 0, "user", "x"), (1, None, "user", None), (1, 1, "assistant", None)]])
def test_plain_transcripts_with_nulls(spark, rows):
    messages = turns_as_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_messages(messages, {"reply": {"prompt": (("STRING",), True), "turn": (("BIGINT",), True)}}).collect()
    assert len(got) == len(rows) and sum(r.name == "reply" for r in got) == sum(r[2] == "user" for r in rows)


def test_every_message_has_a_row_and_calls_may_point_forward(spark):
    rows = [
        (1, 0, "system", "rules"),
        (1, 1, "user", "x" * 7),  # uses the call at turn 3
        (1, 2, "assistant", "a"),
        (1, 3, "user", "one\ntwo"),
        (1, 4, "assistant", "b"),
        (1, 5, "assistant", "c"),
        (1, 6, "tool", "t"),
        (1, 7, None, None),
        (2, 0, "user", "y" * 8),  # and (2, 2) use each other
        (2, 2, "user", "y" * 7),
        (2, 4, "user", None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = {"reply": {"prompt": (("STRING",), True), "turn": (("BIGINT",), True)}}
    got = {(r.conv_id, r.turn): r for r in chat_messages(turns_as_messages(messages), schemas).collect()}
    assert {k: (r.role, json.loads(r.json)["content"]) for k, r in got.items()} == {(c, t): (role, text) for c, t, role, text in rows}
    assert [(got[k].position, got[k].bump, got[k].cyclic) for k in ((1, 1), (1, 3), (2, 0), (2, 2))] == [(3, 1, False), (3, 0, False), (0, 0, True), (2, 0, True)]
    assert [got[k].valid for k in ((1, 1), (1, 3), (2, 0), (2, 4), (1, 2))] == [True, False, True, False, None]
    assert [got[1, t].answers for t in (0, 2, 4, 5, 6, 7)] == [None, "1-1", "1-3", None, None, None]
    assert json.loads(got[1, 3].json)["call"] == {"arguments": {"prompt": "one", "rest": "two", "turn": 3}, "id": "1-3", "name": "reply", "result": "b"}


def test_rows_that_share_an_id_have_their_own_hits(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "clean"), (1, "so " + item), (None, "also clean words"), (None, item), (2, None)]
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=str) == sorted(
        [(1, 1, 0, []), (1, 12, 11, ["5"]), (None, 3, 0, []), (None, 11, 11, ["5"]), (2, 0, 0, [])], key=str
    )
