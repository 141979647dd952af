import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandwork.llm import op1_ogg, op6_html

DOC = "doc_id long, text string, media string, d int"
TEXTS = ["", None, "a", "x" * 192, "y" * 193, "é" * 60_000, "OggS" * 50, "\x00\n\t", "a"]


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))


def test_media_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(TEXTS)], DOC)
    rows = docs.select("doc_id", op1_ogg.decode(op1_ogg.encode(F.col("text"))).alias("m")).orderBy("doc_id").collect()
    for (_, m), text in zip(rows, TEXTS):
        want = padded(text)
        assert bytes(m["payload"]) == want and m["n_bytes"] == len((text or "").encode())
        assert (m["bad_pages"], m["lost"], m["streams"]) == (0, 0, 2) and m["seconds"] == len(want) / op1_ogg.RATE
    assert docs.limit(0).select(op1_ogg.encode(F.col("text"))).count() == 0


def test_media_query_digests(spark, tmp_path):
    from strandwork.llm import queries

    spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(TEXTS)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op1_ogg_media(spark, str(tmp_path)).collect():
        want = padded(TEXTS[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["payload_bytes"] == len(want) and r["tail_crc32"] == zlib.crc32(want[-16:])


def test_checksum_is_the_bitwise_one():
    crc = 0
    for byte in b"OggS and more":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert op1_ogg.checksum(b"OggS and more") == crc


def test_damage_is_found():
    payload = bytes(range(256)) * 3000
    media = op1_ogg.multiplex(payload, 5)
    whole = op1_ogg.demultiplex(media)
    assert b"".join(p for p, _ in whole["streams"][op1_ogg.PCM]["packets"][1:]) == payload
    broken = bytearray(media)
    broken[len(media) // 2] ^= 1
    found = op1_ogg.demultiplex(bytes(broken))
    assert found["bad_pages"] >= 1 and found["lost"] >= 1 and found["pages"] == whole["pages"] - 1
    assert op1_ogg.demultiplex(b"no pages")["pages"] == 0
    assert op1_ogg.demultiplex(media[: len(media) - 3])["pages"] == whole["pages"] - 1


def test_granules_give_times():
    found = op1_ogg.demultiplex(op1_ogg.multiplex(b"z" * 192_000, 192_000))
    times = [s for _, s in found["streams"][op1_ogg.PCM]["packets"][1:] if s is not None]
    assert times == sorted(times) and times[-1] == 24.0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>one<li>two<ul><li>in</ul></ul>", "- one\n- two\n\n  - in"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>a<th>long<tr><td>bbb<td>c</table>", "a    long\nbbb  c"),
        ("a<script>no</script><style>.z{display:none}</style><b class=z>no</b><i hidden>no</i>b", "ab"),
        ("<pre> x\n  y</pre>", " x\n  y"),
        ("a &amp; b &lt;c&gt;", "a & b <c>"),
        ("<!-- no -->yes", "yes"),
    ],
)
def test_layout(page, text):
    assert op6_html.render(page)[0] == text


def test_no_visible_word_is_lost_in_deep_nests(spark):
    page = "<div>" * 500 + "deep <b>words</b>" + "</div>" * 500 + "after"
    out = spark.createDataFrame([(page, 1), (None, 2)], "html string, text int").select(op6_html.extract(F.col("html")).alias("t")).collect()
    assert out[0]["t"]["text"].split() == ["deep", "words", "after"] and out[1]["t"]["text"] == ""
