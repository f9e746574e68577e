import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkstone.llm import chat_tree as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, length int, `a.b` string"


def conversations(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def expected(rows):
    out = {}
    for c, turns in conversations(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        esc = lambda x: sum(2 if ch in "\\<>" else 1 for ch in x)
        size = sum(6 + esc(r) + 2 + esc(x) + 8 for r, x in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def run(spark, rows):
    path = ct.write(spark.createDataFrame([(*r, "n", 1, "x") for r in rows], SCHEMA))
    got = {r.conv_id: tuple(r)[1:] for r in ct.digests(ct.read_turns(spark, path)).collect()}
    return path, got


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 0, "system", None), (4, 1, None, "x"), (4, 1, None, "x"),
        (5, None, "user", r"\### Assistant: </turn> ok <turn assistant>\\"), (5, 3, "assistant", "</turn>\n<turn user>\n\\<"),
        (None, 0, "user", "hi"), (6, 0, "assistant>\n", ""), (7, 0, "user", "hi"), (8, 1, "assistant", "é🎉" * 4000)]


def test_round_trip(spark):
    assert run(spark, ROWS)[1] == expected(ROWS)


def test_shared_turns_are_written_once_depth_first_with_ancestors(spark):
    rows = ROWS + [(c, k, "user", f"{k}-{c % (k + 1)}") for c in range(100, 140) for k in range(4)]
    path, got = run(spark, rows)
    assert got == expected(rows)
    nodes = {r.start: r for r in spark.read.parquet(f"{path}/nodes").collect()}
    prefixes = {tuple(t[:k + 1]) for t in conversations(rows).values() for k in range(len(t))}
    assert len(nodes) == len(prefixes)  # each shared prefix once
    at = 0
    for start in sorted(nodes):  # the stream has no gaps
        assert start == at and len(nodes[start].segment) == nodes[start].length
        at += nodes[start].length
    stream = "".join(nodes[s].segment for s in sorted(nodes))
    members = {}
    for m in spark.read.parquet(f"{path}/members").collect():
        members.setdefault((m.conv_id, m.place), []).append((m.turn, m.start))
    for chain in members.values():
        whole, position = "", 0
        for _, start in sorted(chain):
            n = nodes[start]
            assert n.position == position == len(whole)
            assert "".join(stream[i["from"]:i["to"]] for i in n.attends) == whole  # exactly its ancestors, in order
            whole, position = whole + n.segment, position + n.length
    # depth first: a node's subtree is contiguous
    open_path = []
    for start in sorted(nodes):
        n = nodes[start]
        del open_path[n.depth:]
        assert sum(nodes[s].length for s in open_path) == n.position
        open_path.append(start)


def test_common_first_turn(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", "same" if k == 0 else f"{c} {k}") for c in range(1500) for k in range(2)]
    assert run(spark, rows)[1] == expected(rows)


def test_empty_table(spark):
    assert run(spark, [])[1] == {}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from(["user", "assistant", "<", "\\"]),
                               st.text(alphabet="\\<>/turn \n#é", max_size=8)), min_size=1, max_size=12))
def test_any_text(spark, rows):
    assert run(spark, rows)[1] == expected(rows)


def test_very_long_roles_and_texts(spark):
    role, text = "r<\\>" * 50_000, "t" * 300_000
    rows = spark.createDataFrame([(1, 0, role, text), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    back = ct.read_turns(spark, ct.write(rows)).orderBy("place").collect()
    assert [(r.role, r.text) for r in back] == [(role, text), ("assistant", "ok")]
