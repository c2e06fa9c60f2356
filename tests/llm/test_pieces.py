"""SentencePiece encoding with models that differ from the given one in one part each: a character map, white space, unknown characters."""

import hashlib
import struct

import pytest
import sentencepiece

from stepweave.llm import queries, sentence_pieces

MAP = {"ﬁ": "fi", "½": "1/2", "Å": "A", "Å": "Å", "​": "", "\n": " ", "\t": " ", "　": " ", "ｗｏ": "wo", "ｗ": "w"}
TEXTS = ["Hello  world", "", None, "a\n\nb", "日本語 テスト😀", " lead", "▁odd ▁", "the ﬁrst ｗｏｒｋ ½", "​", "Ångström ﬁ​", "  two   and  three  ", "\t", "end 　", "x" * 3000 + "ﬁ", "😀😀 ☂☂☂ a"]


def compiled(entries):
    """The character map as a double array with a block of 256 units for each node."""
    blocks, values = [{}], b""
    for key, new in entries.items():
        node = 0
        for byte in key.encode():
            if byte not in blocks[node]:
                blocks.append({})
                blocks[node][byte] = len(blocks) - 1
            node = blocks[node][byte]
        blocks[node][0] = len(values)
        values += new.encode() + b"\0"
    units = [0] * (256 * (len(blocks) + 1))
    base = [256 * (k + 1) for k in range(len(blocks))]

    def unit(at, to, label, leaf):
        offset = at ^ to
        assert offset % 256 == 0 or offset < 1 << 21
        return offset << 10 | leaf << 8 | label

    units[0] = unit(0, base[0], 0, 0)
    for k, children in enumerate(blocks):
        for byte, to in children.items():
            at = base[k] ^ byte
            units[at] = 1 << 31 | to if byte == 0 else unit(at, base[to], byte, int(0 in blocks[to]))
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + values


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(n, value):
    return number(n << 3) + number(value) if isinstance(value, int) else (number(n << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else number(n << 3 | 2) + number(len(value)) + value)


def changed(model, normaliser, trainer=None, drop=()):
    """The model with other fields of its normaliser and trainer, without pieces of the types ``drop``."""
    out = []
    for n, value in sentence_pieces._fields(model):
        if n == 1:
            if dict(sentence_pieces._fields(value)).get(3, 1) in drop:
                continue
            out.append(number(n << 3 | 2) + number(len(value)) + value)
        elif n in (2, 3):
            new = {2: trainer or {}, 3: normaliser}[n]
            kept = b"".join(number(m << 3 | (0 if isinstance(v, int) else 2)) + (number(v) if isinstance(v, int) else number(len(v)) + v) for m, v in sentence_pieces._fields(value) if m not in new and not (isinstance(v, bytes) and len(v) == 4 and n == 2))
            out.append(field(n, kept + b"".join(field(m, v) for m, v in new.items())))
        elif n != 4:
            out.append(field(n, value))
    return b"".join(out)


def models():
    given = queries.tokenizer()
    return {"given": given, "mapped": changed(given, {2: compiled(MAP)}), "stripped": changed(given, {4: 1}), "mapped and stripped": changed(given, {2: compiled(MAP), 4: 1}), "no prefix": changed(given, {3: 0}), "unknown": changed(given, {2: compiled(MAP)}, {35: 0}, drop=(6,))}


@pytest.mark.parametrize("name", ["given", "mapped", "stripped", "mapped and stripped", "no prefix", "unknown"])
def test_spans_tile_the_text(spark, name):
    model = models()[name]
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    pieces = {r["doc_id"]: r["pieces"] for r in sentence_pieces.encode_pieces(docs, model).collect()}
    for r in sentence_pieces.encode_digests(docs, model).collect():
        text, found = TEXTS[r["doc_id"]] or "", pieces[r["doc_id"]]
        assert [p["id"] for p in found] == lib.encode(text), text
        assert r["n_tokens"] == len(found) and r["exact"], text
        assert r["spans_sha256"] == hashlib.sha256(b"".join(struct.pack("<qq", p["begin"], p["end"]) for p in found)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((lib.decode(lib.encode(text)) if text else "").encode()).hexdigest()
        at = 0
        for p in found:
            assert p["begin"] == at <= p["end"], text
            at = p["end"]
        assert at == (len(text.encode()) if found else 0)
    if name == "unknown":
        assert any(p["id"] == lib.unk_id() and p["end"] - p["begin"] > 4 for found in pieces.values() for p in found)


def test_longest_prefix_wins():
    text, align = sentence_pieces.CharacterMap(compiled(MAP)).apply("éｗｏｗﬁ½")
    assert text == "éwowfi1/2" and align == [0, 0, 2, 2, 8, 11, 11, 14, 14, 14, 16]
    text, align = sentence_pieces.CharacterMap(b"").apply("  a  b ", strip=True)
    assert text == "a b" and align == [2, 3, 5, 6]


def test_options_that_are_refused():
    with pytest.raises(ValueError):
        sentence_pieces.Encoder(changed(queries.tokenizer(), {5: 0}))
