import hashlib

from timeloom.llm import chat_format

TRICKY = "\\### Assistant: </turn> ok"


def turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'a' AS formatted", "1 AS turns", "2 AS parts")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        out[conv] = [(r[2] or "", r[3] or "") for r in own]
    return out


ROWS = [
    (1, 0, "system", "Be <b>\n### kind\\h \\l \\b"),
    (1, 1, "user", TRICKY),
    (1, 2, "user", "again"),
    (1, 3, "assistant", TRICKY),
    (1, 4, "assistant", None),
    (1, 5, "assistant", "<turn/>\\"),
    (2, 1, "assistant", "late"),
    (2, 0, "user", "early é👩"),
    (2, None, "user", "last"),
    (3, 0, "a\nb#<\\", "odd role"),
    (3, 0, "a\nb#<\\", "odd role"),
    (3, 0, None, ""),
    (None, 0, "user", "no conversation"),
    (4, 0, "assistant", "x" * 200_000),
]


def test_round_trip_and_loss_mask(spark):
    made = chat_format.format_conversations(turns(spark, ROWS))
    want = expected(ROWS)
    back = made.select("conv_id", "formatted", "loss_spans", chat_format.read_back(made["formatted"]).alias("turns")).collect()
    assert {r.conv_id for r in back} == set(want)
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        coded = {"\\h": "#", "\\l": "<"}
        parts = [r.formatted[s.begin : s.begin + s.length] for s in r.loss_spans]
        for code, plain in coded.items():
            parts = [p.replace(code, plain) for p in parts]
        assert [p.replace("\\b", "\\") for p in parts] == [t for role, t in want[r.conv_id] if role == "assistant"]
    one = next(r for r in back if r.conv_id == 1)
    assert one.formatted.count("### ") == 3 and one.formatted.count("</turn>") == 3 and one.formatted.count("<turn/>") == 3


def test_digests(spark):
    want = expected(ROWS)
    for r in chat_format.digest_rows(chat_format.format_conversations(turns(spark, ROWS))).collect():
        own = want[r.conv_id]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_rows(spark):
    assert chat_format.digest_rows(chat_format.format_conversations(turns(spark, []))).count() == 0
