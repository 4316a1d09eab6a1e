import hashlib
import random
import re

from pyspark.sql import functions as F

from residua.llm import chat as op

SCHEMA = "conv_id long, turn int, role string, text string, run int, tokens string, Loss string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "l", 2) for r in rows], SCHEMA)


def escaped(text):
    return re.sub("#(?=##)", r"#\\", text.replace("\\", "\\\\")).replace("</turn", "<\\/turn")


def n_pieces(text):
    found, word = 0, False
    for ch in text:
        if ch.isalpha() or ch.isnumeric():
            found += not word
            word = True
        else:
            word = False
            found += ch not in " \t\n\x0b\x0c\r"
    return found


def expected(rows, budget, history):
    """Windows by a loop over each conversation: (conv, run, part): (repeated, tokens, text, loss texts)."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, f"### {escaped(role or '').replace(':', chr(92) + ':')}: ", escaped(text or ""), role or ""))
    for conv, turns in convs.items():
        turns.sort()
        size = lambda t: n_pieces(t[2] + t[3] + "</turn>\n")
        by_run = {}
        for t in turns:
            by_run.setdefault(t[1] // op.RUN if t[0] else -(1 << 56), []).append(t)
        top = [turns[0]] if turns[0][4] == "system" else []
        before = []
        for k, (run, own) in enumerate(sorted(by_run.items())):
            body = own[len(top):] if k == 0 else own
            cuts, start = [], 0
            for i in range(len(body)):
                room = budget - sum(map(size, top)) - (0 if k == 0 and start == 0 else history)
                if i > start and sum(map(size, body[start : i + 1])) > room:
                    cuts.append((start, i))
                    start = i
            cuts.append((start, len(body)))
            for part, (a, b) in enumerate(cuts):
                past = (before + body)[: len(before) + a]
                while sum(map(size, past)) > history:
                    past = past[1:]
                fresh = k == 0 and part == 0
                listed = top + past + body[a:b]
                loss = [t[3] for t in body[a:b] if t[4] == "assistant"]
                out[conv, run, part] = (len(past) + (0 if fresh else len(top)), sum(map(size, listed)), "".join(t[2] + t[3] + "</turn>\n" for t in listed), loss)
            before = body
            while sum(map(size, before)) > history:
                before = before[1:]
    return out


def conversations():
    rng = random.Random(3)
    words = ["a", "###", "####", "\\", "\\#", "</turn>", "</turn", "<\\/turn>", "### assistant: ", "é", "日本", "😀", "\n", ":", "x" * 40, ""]
    rows = []
    for conv in range(30):
        n, turn = rng.choice([1, 2, 7, 40]), 0
        for i in range(n):
            role = "system" if i == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "system", "a: b\\", None])
            rows.append((conv, turn, role, rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 30)))])))
            turn += rng.choice([1, 1, 1, 0, 90])  # ties and gaps
    rows += [(99, i, "user" if i % 2 else "assistant", f"turn {i} says") for i in range(700)]
    rows += [(98, None, "assistant", "no number"), (98, 1, "assistant", "one"), (98, 1, "assistant", "one"), (97, 0, "system", "alone"), (None, 0, "assistant", "no conversation"), (96, 0, "assistant", "long " * 30_000), (96, 1, "user", None)]
    return rows


def test_windows_equal_a_loop(spark):
    rows = conversations()
    for budget, history in ((60, 20), (200, 0), (2048, 256)):
        got = {}
        for r in op.chat_windows(frame(spark, rows), budget, history).collect():
            got[r.conv_id, r.run, r.part] = (r.repeated, r.tokens, r.text, [r.text[s.start : s.stop] for s in r.loss])
        want = expected(rows, budget, history)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == want[k], k
        assert all(v[1] <= budget or len(v[3]) <= 1 for v in got.values())


def test_reads_back_every_turn_once(spark):
    rows = conversations()
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, f"### {escaped(role or '').replace(':', chr(92) + ':')}: ", escaped(text or ""), role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[4] == "assistant")
        want[conv] = (len(turns), digest("".join(f"{t[4]}\n{t[5]}\n" for t in turns)), len(loss), digest(loss))
    for budget, history in ((60, 20), (2048, 256)):
        windows = op.chat_windows(frame(spark, rows), budget, history)
        chars = {r.conv_id: r.n for r in windows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
        got = {r.conv_id: tuple(r)[1:] for r in op.read_back(windows).collect()}
        assert {k: v[:4] for k, v in got.items()} == want
        assert {k: v[4] for k, v in got.items()} == chars


def test_control_strings_cannot_open_a_turn(spark):
    text = r"\### Assistant: </turn> ok"
    windows = op.chat_windows(frame(spark, [(-7, 0, "user", text), (-7, 1, "assistant", text)])).collect()
    assert len(windows) == 1 and windows[0].text.count("</turn>") == 2 and windows[0].text.count("###") == 2
    turns = op.chat_windows(frame(spark, [(-7, 0, "user", text), (-7, 1, "assistant", text)])).select(op.turns_of(F.col("text")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [("user", text), ("assistant", text)]
    assert op.chat_windows(frame(spark, [])).count() == 0 and op.read_back(op.chat_windows(frame(spark, []))).count() == 0
