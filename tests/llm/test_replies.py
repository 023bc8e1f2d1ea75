"""Links by deeper quotes, by short ones; messages of several texts."""

import random

from glyphmill.llm import quotes


def test_deeper_short_and_repeated_messages(spark):
    messages = [
        (1, 0, "user", "The original question of all."), (1, 1, "assistant", "I agree."), (1, 2, "user", ">> The original question of all.\n> never stored anywhere\nMy reply."),
        (1, 3, "user", "> I agree.\nSo do I."), (2, 0, "user", "> I agree.\nOver here."), (3, 0, "user", "Real words of a message."), (3, 0, "user", None), (3, 0, "user", "Real words of a message."),
        (3, 1, "user", "> Real words of a message.\nYes."), (4, 0, "user", "> My reply.\n>> The original question of all.\nDeep."),
    ]
    got = quotes.conversations(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    rows = {(r.conv_id, r.turn): r for r in got}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in rows.items()}
    assert parent[1, 2] == (1, 0) and parent[1, 3] == (1, 1) and parent[2, 0] == (None, None) and parent[3, 1] == (3, 0)
    assert parent[4, 0] == (1, 0)  # "My reply." is short, so only the deeper quote links over conversations
    assert sorted(r.body for r in got if (r.conv_id, r.turn) == (3, 0)) == ["", "Real words of a message."] and len(got) == len(messages) - 1


def by_loops(rows):
    """(conv, turn) -> its parent, each quoted unit compared with every message."""
    said, asked = [], {}
    for conv, turn, _, text in rows:
        for level, h, wide in quotes.units(text or ""):
            if level:
                asked.setdefault((conv, turn), set()).add((level, h))
            else:
                said.append((conv, turn, h, wide))
    out = {}
    for (conv, turn), units in asked.items():
        found = {}
        for level, h in units:
            own = min((t for c, t, x, _ in said if x == h and c == conv), default=None)
            first = min(((c, t) for c, t, x, wide in said if x == h and wide), default=None)
            parent = (conv, own) if own is not None and own < turn else first if first and first[0] < conv else None
            if parent:
                found[level, parent] = found.get((level, parent), 0) + 1
        if found:
            level = min(k for k, _ in found)
            out[conv, turn] = max((n, p) for (k, p), n in found.items() if k == level)[1]
    return out


def test_generated_threads_by_loops(spark):
    rng = random.Random(21)
    phrases = [" ".join(rng.choice(["yes", "no", "the", "cat", "Sat", "down", "again"]) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = []
    for conv in range(50):
        texts = []
        for turn in range(rng.randint(1, 8)):
            lines = []
            for old in rng.sample(texts, min(len(texts), rng.randint(0, 2))):
                lines += ["On Monday someone wrote:"] * (rng.random() < 0.3) + ["> " + x for x in old.split("\n") if rng.random() < 0.9]
            if rng.random() < 0.2:
                lines.append(">" * rng.randint(1, 3) + " " + rng.choice(phrases))
            lines += [rng.choice(phrases) for _ in range(rng.randint(0, 3))]
            texts.append("\n".join(lines))
            rows.append((conv, turn, "user", texts[-1] if rng.random() < 0.95 else None))
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = by_loops(rows)
    assert {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in got if r.parent_conv is not None} == want and len(want) > 40

    def root(m):
        depth = 0
        while m in want:
            m, depth = want[m], depth + 1
        return (*m, depth)

    assert all((r.thread_conv, r.root_turn, r.depth) == root((r.conv_id, r.turn)) for r in got) and max(r.depth for r in got) >= 3
    assert not any(line.startswith(">") for r in got for line in r.body.split("\n"))


def test_long_introducing_lines_go():
    assert quotes.body_of("On " + "x " * 400 + "wrote:\n> old\nnew") == "new"
