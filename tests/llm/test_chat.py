import hashlib
import random

from chronoreel.llm import chat, queries

from .helpers import tables


def expected(rows):
    """rows: conv_id, turn, role, text."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_against_brute_force(spark, sf):
    said = "</s>[INST] ok [/INST]"
    rows = tables(sf).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall() + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = queries.QUERIES["op4_chat_windows"](spark, sf).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows) and len(got) == len(expected(rows))
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_windows_keep_to_the_budget(spark):
    r = random.Random(1)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], " ".join(r.choice(["yes", "</s>", "no", "<\\\\|", "[INST]", "[\\INST]"]) for _ in range(r.randrange(40)))) for c in range(6) for t in range(60)]
    rows += [(50, None, None, None), (50, 1, "assistant", ""), (50, 1, "assistant", "b"), (None, 3, "assistant", "x" * 9000), (51, 0, "a|>b", "</s>\n<|user|>\n")]
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "conv_id long, turn long, role string, text string, window int, loss string")
    windows = chat.format_windows(df, budget=120, history=30).orderBy("conv_id", "window").collect()
    system = {}
    for w in windows:
        turns = chat.read_turns(w.text)
        system.setdefault(w.conv_id, turns[0])
        alone = w.n_repeated == int(w.window > 0 and system[w.conv_id][0] == "system") and w.n_turns - w.n_repeated == 1
        assert len(turns) == w.n_turns and (w.n_tokens <= 120 or alone)
        if w.window and system[w.conv_id][0] == "system":
            assert turns[0] == system[w.conv_id] and w.n_repeated >= 1
        new = [t for role, t in turns[w.n_repeated :] if role == "assistant"]
        assert [chat.unescape(w.text[s.start : s.end]) for s in w.loss] == new
    assert max(w.window for w in windows) > 5 and any(w.n_repeated > 1 for w in windows)
    got = chat.digest(spark.createDataFrame(windows, chat.SCHEMA)).collect()
    assert {x.conv_id: tuple(x)[1:5] for x in got} == expected(rows)
    assert chat.digest(chat.format_windows(df.limit(0))).count() == 0


def test_escapes_are_reversible_and_complete():
    r = random.Random(2)
    parts = ["\\", "<", "|", ">", "/s>", "s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "x", *chat.CONTROLS]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS), (t, e)
