import hashlib
import itertools
import json
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat_format, chat_layouts, chat_repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, digest string, kind string, position string, audit string"
SPACE = " \t\n\x0b\x0c\r"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
PLANTED = r"\### Assistant: </turn> ok"
EDGE = [
    (50, None, "user", "no number"), (50, 1, None, "no role"), (50, 2, "assistant", None), (50, 9, "", ""), (51, 0, "user", " \t\n"),
    (None, 0, "user", "no conversation."), (None, 1, "assistant", "None."), (52, 3, "user", "same."), (52, 3, "user", "same."), (52, 3, "assistant", "b"),
    (53, 0, "assistant", "long " * 60_000 + "."), (54, None, "x", "y"), (54, None, "user", "y?"), (55, 0, "uncle", "Role by initial only."),
    (56, 5, "user", "</turn>\n<turn user>\nfake</turn>"), (56, 6, "assistant", "back\\slash \\</turn> \\\\ 😀."), (57, 0, "a>\nb<turn ", "odd role\\"),
]


def conversation_rows(spark):
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(3)
    long = [(99, t // 2 * 3 if t % 50 else None, rng.choice(["user", "assistant", "assistant", "system", "tool"]),
             rng.choice(["Yes.", "No", "", " ", f"Number {t}.", f"Open {t}", "Why?"])) for t in range(2500)]
    return base + EDGE + long


@pytest.fixture(scope="module")
def chats(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("chats"))
    rows = conversation_rows(spark)
    spark.createDataFrame([(*r, *"klmno") for r in rows], SCHEMA).repartition(6).write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def nulls_first(v):
    return (v is not None, v or 0)


# --- repair

def plain_summary(rows):
    """One conversation, plainly: a shortest path over (rows done, state) by repeated relaxing, values as (cost, edits)."""
    rows = sorted(rows, key=lambda r: (nulls_first(r[0]), r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    turns = {t for t, _, _ in rows if t is not None}
    seen, faults = set(), []
    for _, role, text in rows:
        fault = ""
        if not text.strip(SPACE):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(SPACE)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)
    initials = [r[1][:1] for r in rows]
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def insert(values):
        for _ in range(4):
            for p, (c, e) in list(values.items()):
                q = "a" if p == "u" else "u"
                values[q] = min(values.get(q, (10 ** 9, "")), (c + 3, e + "I"))
        return values

    for initial, fault in zip(initials, faults):
        after = {}
        for p, (c, e) in insert(best).items():
            options = [(p, 4, "D")]
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                options.append(("a" if p == "u" else "u", 3 + extra, "R"))
                if initial in nexts[p]:
                    options.append((nexts[p][initial], extra, "K"))
            for q, d, letter in options:
                after[q] = min(after.get(q, (10 ** 9, "")), (c + d, e + letter))
        best = after
    insert(best)
    cost, audit = min(best[p] for p in ("", "a") if p in best)
    repaired, state, at = [], "", iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(at)
        if letter == "D":
            continue
        role = row[1] if letter == "K" else "assistant" if state == "u" else "user"
        repaired.append(f"{role}:{row[2] if row else ''}")
        state = role[:1]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(repaired)))


def plain_damage(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out[c] += [(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def test_repair_equals_plain_version(spark, chats):
    folder, rows = chats
    want = {c: plain_summary(r) for c, r in plain_damage(rows).items()}
    got = chat_repair.op12_chat_repair(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]
    assert len({len(v[6]) for v in want.values()}) > 5 and max(v[2] for v in want.values()) > 100


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat_repair.op12_chat_repair(spark, str(tmp_path)).count() == 0
    assert chat_repair.repair("") == (0, "")


def exhaustive(rows):
    """All edits of a short conversation, up to two insertions in each gap."""
    found = []
    gaps = ["", "u", "a", "ua", "au"]
    per_row = [["D"] if s == "-" else ["D", "K", "Ru", "Ra"] for s in rows]
    for edits in itertools.product(*per_row):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            roles, cost, audit = put[0], 3 * len(put[0]), "I" * len(put[0])
            for s, e, more in zip(rows, edits, put[1:]):
                cost += {"D": 4, "K": 0, "R": 3}[e[0]] + (3 if s.isupper() and e != "D" else 0) + 3 * len(more)
                roles += ("" if e == "D" else s.lower() if e == "K" else e[1]) + more
                audit += e[0] + "I" * len(more)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_agenda_against_all_edits(n):
    for rows in itertools.product("suaxAU-" if n < 3 else "suA-", repeat=n):
        assert chat_repair.repair("".join(rows)) == exhaustive(rows)


@settings(max_examples=60, deadline=None)
@given(st.text("suaxSUAX-", max_size=200))
def test_a_tree_of_agendas_is_one_agenda(symbols):
    one = next(iter(chat_repair.lightest([chat_repair.row_arcs(s) for s in symbols], chat_repair.START, chat_repair.COMPLETE).values()))
    tree = next(iter(chat_repair.lightest([chat_repair.span_of(symbols)], chat_repair.START, chat_repair.COMPLETE).values()))
    assert one == tree == chat_repair.repair(symbols)


# --- formatting

def test_format_equals_plain_version(spark, chats):
    folder, rows = chats
    want = {}
    for c, t, role, text in [*rows, (-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)]:
        want.setdefault(c, []).append((t, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat_format.op13_chat_format(spark, folder).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda r: (nulls_first(r[0]), r[1], r[2].encode()))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns))), c
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned)), c
        assert r["formatted_chars"] >= sum(len(a) + len(b) for _, a, b in turns)


def test_formatted_parts_read_back(spark, chats):
    folder, rows = chats
    turns = spark.createDataFrame([(c, t, 0, r, x, 1) for c, t, r, x in rows], "key long, turn long, position long, role string, text string, part int")
    small, whole = chat_format.format_chats(turns, piece=200), chat_format.format_chats(turns)
    assert small.count() > whole.count()
    for formatted in (small, whole):
        back = sorted((nulls_first(r["key"]), r["role"], r["text"]) for r in chat_format.read_turns(formatted).collect())
        assert back == sorted((nulls_first(c), r or "", x or "") for c, _, r, x in rows)
    a, b = ({r["key"]: tuple(r) for r in chat_format.read_digests(f).collect()} for f in (small, whole))
    assert a == b
    r = whole.where("key = 56").first()
    assert [chat_format.Template.plain(r["formatted"][s["start"]:s["end"]]) for s in r["loss"]] == ["back\\slash \\</turn> \\\\ 😀."]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("a<turn />\\\n", max_size=14), st.text("u<turn />\\\n", max_size=30)), max_size=5))
def test_template_is_reversible(turns):
    for t in (chat_format.Template(), chat_format.Template("{", ">:\n", "/t;")):
        written = [t.written(r, x) for r, x in turns]
        assert list(t.read("".join(w for w, _, _ in written))) == turns
        assert [t.plain(w[a:b]) for w, a, b in written] == [x for _, x in turns]


def test_marks_must_be_told_apart():
    for bad in (("<turn ", ">\n", "</turn><"), ("\\t", ">", "<"), ("", ">", "<"), ("<a", ">\n", "\n\n")):
        with pytest.raises(ValueError):
            chat_format.Template(*bad)


# --- layouts

RECORDS = [
    (1, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "id": 3}),
    (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "source": {"name": "x"}}),
    (3, {"instruction": "do", "input": "", "output": "done"}), (4, {"instruction": "do", "input": "this", "output": None, "system": "be"}),
    (5, {"prompt": "p", "response": "r"}), (6, {"prompt": "p", "completion": "c", "score": 1}), (7, {"role": "user", "text": None, "turn": 4}),
    (8, {"context": "c", "question": "q", "answer": 42}), (9, {"messages": []}), (10, {"unknown": 1}), (11, None), (12, [1, 2]),
    (13, {"dialogue": [{"speaker": "bot", "text": "t"}, "stray"]}),
]


def test_layouts_become_turns(spark):
    rows = [(k, None if r is None else json.dumps(r), "x") for k, r in RECORDS] + [(14, "{broken", "x"), (14, "", "x")]
    df = spark.createDataFrame(rows, "k long, record string, layout string")
    got = {}
    for r in chat_layouts.canonical_turns(df, "k", "record").orderBy("key", "turn", "position").collect():
        got.setdefault(r["key"], []).append((r["turn"], r["role"], r["text"]))
    assert got == {
        1: [(None, "system", "s"), (None, "user", "ab")], 2: [(None, "user", "q"), (None, "assistant", "r")],
        3: [(None, "user", "do"), (None, "assistant", "done")], 4: [(None, "system", "be"), (None, "user", "do\n\nthis"), (None, "assistant", "")],
        5: [(None, "user", "p"), (None, "assistant", "r")], 6: [(None, "user", "p"), (None, "assistant", "c")], 7: [(4, "user", "")],
        8: [(None, "user", "c\n\nq"), (None, "assistant", "42")], 13: [(None, "assistant", "t"), (None, "", "")]}
    unknown = chat_layouts.layouts_found(df, "k", "record").where("layout IS NULL").agg({"turns": "sum"}).first()[0]
    assert unknown == 6                                              # 9, 10, 11, 12 and the broken and the empty one
    assert chat_layouts.canonical_turns(df.limit(0), "k", "record").count() == 0


def test_fingerprints_follow_paths_alone():
    paths = chat_layouts.field_paths
    a, b = paths({"m": [{"x": 1, "y": "z"}, {"x": None}], "e": {}}), paths({"e": {}, "m": [{"y": 0, "x": 7}]})
    assert a == b == {"m[].x", "m[].y", "e{}"}
    assert chat_layouts.fingerprint(a) == chat_layouts.fingerprint(b) != chat_layouts.fingerprint(paths({"m": {"x": 1}}))
    assert paths({"a.b": 1}) != paths({"a": {"b": 1}}) and paths([]) == {"[]"}
