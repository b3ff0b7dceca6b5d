"""Chat templates: exact round trips and masks."""

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string, formatted string"
HOSTILE = st.lists(st.sampled_from([*C.CONTROL, "\\", "[", "</s>", "<\\s>", "<\\\\/s>", "a", " ", "\n", "é", "😀", "[\\INST]"]), max_size=12).map("".join)
ROLE = st.sampled_from(["system", "user", "assistant", "tool", "", "as[:]sistant"])


@settings(deadline=None, max_examples=300)
@given(HOSTILE)
def test_escaping_is_reversible_and_hides_control_strings(text):
    assert C.unescape(C.escape(text)) == text
    assert not any(c in C.escape(text) for c in C.CONTROL)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(ROLE, HOSTILE), max_size=6))
def test_rendered_turns_read_back(turns):
    assert [(t.role, t.text) for t in C.parse(C.render(turns))] == turns


TOKENIZER = C.load_tokenizer(C.public_tokenizer())


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(ROLE, HOSTILE), max_size=6))
def test_the_mask_covers_assistant_texts_exactly(turns):
    formatted = C.render(turns)
    coded = TOKENIZER.encode(formatted, add_special_tokens=False)
    spans = C.masked_spans(coded.offsets, C.mask_tokens(coded.offsets, C.parse(formatted)))
    assert "".join(C.unescape(formatted[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def digests(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.render([(r, x) for _, r, x in turns]))))
    return sorted(map(repr, out))


def test_conversations_nulls_ties_and_long_ones(spark, monkeypatch):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "assistant", None), (None, None, "tool", "t"), (3, 5, "assistant", "a b\n" * 400), (3, 6, "user", "z" * 900), (3, 7, "assistant", "end ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    run = lambda: sorted(map(repr, map(tuple, C.digest_chats(C.format_chats(df)).select(*names).collect())))
    assert run() == digests(rows)
    assert C.format_chats(spark.createDataFrame([], ROWS)).collect() == []


def test_parts_read_back_as_one_conversation():
    turns = [("user", "question"), ("assistant", "answer")] * 3
    assert "".join(C.render(turns[i : i + 2]) for i in (0, 2, 4)) == C.render(turns)
