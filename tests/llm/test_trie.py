"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib

from panelwright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _label(turn):
    role, text = turn[1] or "", turn[2] or ""
    return hashlib.sha256(f"{len(role)} {role}{text}".encode()).hexdigest()[:32]


def sequences(rows) -> dict[int, list[tuple[str, str]]]:
    convs: dict[int, list] = {}
    for c, *turn in rows:
        if c is not None:
            convs.setdefault(c, []).append(tuple(turn))
    order = lambda t: (t[0] is not None, t[0] or 0, (t[1] or "")[:64], _label(t))
    return {c: [(r or "", x or "") for _, r, x in sorted(turns, key=order)] for c, turns in convs.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return {c: convs.get(c - c % 100, [])[: h[c]] + turns[h[c] :] for c, turns in convs.items()}


def plain(convs) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out, below = set(), {}
    for path in sorted(members, key=len, reverse=True):
        under = [below[c] for c in children.get(path, [])]
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        below[path] = (sum(u[0] for u in under) or 1, own + sum(u[1] for u in under))
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(convs[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(members[path]), len(path), parent, len(members[path]), len(under), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def _queried(spark, rows, folder) -> list[tuple]:
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return _rows(trie.op11_conversation_trie(spark, str(folder)))


def test_op11_whole_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        got = _rows(trie.op11_conversation_trie(spark, f"/root/testdata/{sf}"))
        want = plain(rebuilt(sequences(rows)))
        assert len(got) == len(want) and set(got) == want


def test_op11_odd_rows(spark, tmp_path):
    """Null and repeated turns, null roles and texts, absent bases, turnless conversations, copies, one long conversation and one that begins it."""
    draw, rows = random.Random(5), []
    for c in [*range(40), *range(100, 140, 3), *range(205, 300, 7), 10**12, -3]:
        for t in range(draw.randrange(1, 9)):
            rows.append((c, draw.choice([t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(["", "hi", "wörter 𝔸", None])))
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 360) for t in range(7)]
    rows += [(401, t, "user", f"long {t}") for t in range(300)] + [(402, t, "user", f"long {t}") for t in range(170)]
    rows += [(None, 1, "user", "nobody's"), (7, 0, "user", "twice"), (7, 0, "user", "twice")]
    got, want = _queried(spark, rows, tmp_path / "odd"), plain(rebuilt(sequences(rows)))
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in want)
    assert _queried(spark, [], tmp_path / "none") == []


def test_logged_trie_and_intervals(spark):
    """Without rebuilding, conversations that share more than a block of turns; a subtree is a range of positions."""
    rows = [(c, t, "user", f"{t if t < 40 - c % 3 else (c, t)}") for c in range(1, 12) for t in range(60 - 3 * c)]
    rows += [(c, t, "user", f"{t}") for c in range(20, 30) for t in range(10 * (c - 20), 0, -1)]
    df = trie.of_conversations(spark.createDataFrame(rows, SCHEMA))
    assert set(_rows(df)) == plain(sequences(rows))
    nodes = df.collect()
    assert sorted(r.position for r in nodes) == list(range(1, len(nodes) + 1))
    for r in nodes:
        inside = [x for x in nodes if r.position < x.position <= r.subtree_end]
        assert sum(x.depth == r.depth + 1 for x in inside) == r.n_children and all(x.depth > r.depth for x in inside)
        assert sum(x.n_children == 0 for x in inside) + (r.n_children == 0) == r.n_leaves
