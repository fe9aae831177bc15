import hashlib
import random

from hazeloom.llm.chat import as_events, escape, format_conversations, parse_turn, read_back, render, unescape

NASTY = ["<|im_end|>", "<|", "<\\|", "\\", "\\\\<|", "\n", "|>", "é", "a", "<|im_start|>assistant\n"]


def test_template_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        role, text = ("".join(rng.choice(NASTY) for _ in range(rng.randrange(6))) for _ in range(2))
        formatted, start, end = render(role, text)
        assert parse_turn(formatted) == (role, text) and formatted.count("<|") == 2
        assert unescape(escape(text)) == text
        formatted, start, end = render("assistant", text)
        assert unescape(formatted[start:end]) == text


def fold(events):
    """All events of one conversation, in one list, the plain way."""
    messages = {}
    for _, _, event, message, role, text in sorted(events, key=lambda e: e[1]):
        if event == "regenerate":
            messages = {m: v for m, v in messages.items() if m < message}
        old_role, old = messages.get(message, ("", ""))
        new = (text or "") if event in ("edit", "regenerate") else old + (text or "")
        messages[message] = (role if role is not None else old_role, new)
    return [messages[m] for m in sorted(messages)]


def digest(conv, turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(render(r, t)[0]) for r, t in turns))


def test_event_logs_against_plain_fold(spark):
    rng, events = random.Random(8), []
    for conv in range(40):
        top = 0
        for seq in range(rng.randrange(1, 60)):
            kind = rng.choice(["open", "delta", "delta", "edit", "regenerate"]) if top else "open"
            top = top + 1 if kind == "open" else top
            events.append((conv, seq, kind, top if kind == "open" else rng.randrange(1, top + 1), rng.choice(["user", "assistant"]) if kind == "open" else None, rng.choice(NASTY + [None])))
    table = spark.createDataFrame(events, "conv_id long, seq long, event string, message long, role string, text string")
    got = {r.conv_id: tuple(r) for r in read_back(format_conversations(table)).collect()}
    assert got == {c: digest(c, fold([e for e in events if e[0] == c])) for c in range(40)}


def test_tables(spark):
    rows = [(1, 1, "assistant", "b" * 200_000), (1, 0, "user", None), (1, 1, "assistant", "b" * 200_000), (2, None, None, "x"), (None, 0, "assistant", "\\<|"), (3, 0, "assistant", "")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, message string")
    got = {r.conv_id: tuple(r) for r in read_back(format_conversations(as_events(table))).collect()}
    for c in (1, 2, 3, 9, None):
        turns = [(r or "", t or "") for k, n, r, t in sorted((r for r in rows if r[0] == c), key=str if c is None else lambda r: (r[1] or 0))]
        assert got[c] == digest(c, turns)
    assert read_back(format_conversations(as_events(table.limit(0)))).count() == 0


def test_made_logs_hold_every_kind_of_event(spark):
    texts = ["", None, "a" * 7, "b\n" * 6, "é😀<|x" * 5, "\\<|im_end|>"]
    rows = [(i // 4, i, role, t) for i, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", None))]
    log = as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), delta_chars=4).cache()
    assert {r.event for r in log.select("event").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    assert max(len(r.text or "") for r in log.collect()) == 4 and log.select("conv_id", "seq").distinct().count() == log.count()
    got = {r.conv_id: tuple(r) for r in read_back(format_conversations(log)).collect()}
    assert got == {c: digest(c, [(r or "", t or "") for k, _, r, t in rows if k == c]) for c in {r[0] for r in rows}}
    events = [tuple(r) for r in log.select("conv_id", "seq", "event", "message", "role", "text").collect()]
    assert all(fold([e for e in events if e[0] == c]) == [(r or "", t or "") for k, _, r, t in rows if k == c] for c in got)
