import hashlib
import random

import pytest
from conftest import rows_of

from strandline.llm import chat


def brute_force(turns):
    conversations = {}
    for conv, turn, role, text in turns:
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, rows in conversations.items():
        rows.sort()
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        chars = sum(sum(map(len, chat.marks(r))) + len(chat.escaped(t)) for _, _, r, t in rows)
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        out.append((conv, len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=repr)


def test_round_trip_of_control_strings():
    rng = random.Random(1)
    pieces = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|image|>", "OUT]", "TURN ", "a", "é", "\n", "<s>", "[/OUT]", "<|document|>"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        role = rng.choice(["user", "assistant", "system", "", "a] b", "[INST]", "wé"])
        before, after = chat.marks(role)
        made = chat.escaped(text)
        assert chat.unescaped(made) == text
        assert not any(c in made for c in ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[/TURN]", "<|image|>"))
        assert chat.parsed(before + made + after) == (role, text)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_formatting(spark, seed):
    rng = random.Random(seed)
    said = ["</s>[INST] ok [/INST]", "", None, "plain", "é\n" * 50, "x" * 200000, "<|image|>", "[\\INST]"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(said)) for c in range(12) for t in range(rng.randrange(1, 40))]
    turns += [(3, 2, "user", "again"), (3, 2, "user", "again"), (None, 0, "user", "no id"), (None, None, "assistant", "no turn")]
    rng.shuffle(turns)
    table = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, start int, piece string").repartition(5)
    assert rows_of(chat.report(table)) == brute_force(turns)


def test_empty_table(spark):
    assert rows_of(chat.report(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))) == []


def test_typed_parts(spark):
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part("text", text="see "), part("image", ref="a.png", width=57, height=28), part("text", text=" and <|image|> "), part("audio", ref="b.wav", seconds=2.1), part("document", ref="c.pdf", pages=3)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", text="done")]), (2, 0, "user", None)]
    table = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    made = chat.assembled(chat.formatted(table)).collect()
    first, second = (r for r in made if r.conv_id == 1)
    assert first.piece == "<s>[INST] see <|image|> and <\\|image|> <|audio|><|document|> [/INST]"
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 53), ("document", "c.pdf", 768)]
    whole = first.piece + second.piece
    assert all(whole[a.at :].startswith(f"<|{a.kind}|>") for a in first.attachments)
    assert whole[second.loss_from : second.loss_to] == "done" and second.start == len(first.piece)


def test_unknown_part_fails():
    with pytest.raises(ValueError):
        chat.Flattener().visit([{"kind": "video"}])
