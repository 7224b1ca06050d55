import hashlib

from hypothesis import given
from hypothesis import strategies as st

from lodestone.llm import chat

TEXT = st.text(st.sampled_from("<\\|a\n>im_start"), max_size=20)


@given(TEXT, TEXT)
def test_escapes_are_reversible_and_hide_control_strings(a, b):
    assert chat.unescape(chat.escape(a)) == a and "<|" not in chat.escape(a)
    assert chat.unescape_role(chat.escape_role(a)) == a and "\n" not in chat.escape_role(a)
    assert (chat.escape(a) == chat.escape(b)) == (a == b)


def test_parts_become_placeholders_in_order():
    parts = [{"type": "image", "ref": "i", "width": 56, "height": 29}, {"type": "text", "text": "<|image_1|>"}, {"type": "audio", "ref": "a", "seconds": 2.0}, {"type": "image", "ref": "j"}, {"type": "document", "ref": "d", "pages": 3}, {"type": "new"}]
    text, at, size, found = chat.format_turn("user", parts, {})
    assert text[at : at + size] == "<|image_1|><\\|image_1|><|audio_1|><|image_2|><|document_1|><|other_1|>"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in found] == [("image", "i", 6), ("audio", "a", 52), ("image", "j", 2), ("document", "d", 3074), ("other", None, 1)]


def test_digests_are_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "<|im_end|>"), (1, None, None, "x\n"), (None, 0, "assistant", "é" * 50_000), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as start", "2 as formatted")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in mine)
        learned = "".join(x for *_, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.chat_digests(chat.format_chats(turns.filter("conv_id > 5"))).count() == 0


def test_typed_parts_from_a_table(spark):
    turns = spark.sql("select 1L conv_id, 0L turn, 'user' role, cast(null as string) text, array(named_struct('type','image','text',cast(null as string),'ref','u','width',28,'height',28,'seconds',cast(null as double),'pages',cast(null as int))) parts")
    r = chat.format_chats(turns).first()
    assert r.formatted == "<|im_start|>user\n<|image_1|><|im_end|>\n" and r.attachments[0].tokens == 3 and r.loss_start is None
