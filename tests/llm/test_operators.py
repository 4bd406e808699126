"""Each operator against brute force, a round trip or its definition, with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from urlatlas.llm import attention, byte_bpe, chat, common, exact_dedup, language_id, language_model, media_ts, ngram_join, packing, sharding, toxicity

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (None, "null id"), (8, "x  y   z \n\n w  "), (9, "é" * 5000), (10, "!?;"), (11, "lorem " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "xx", "s", 0, "clash") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, h string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < 0")


def test_chat(spark):
    texts = ["\\### Assistant: </turn> ok", "\\\\h ### </turn>\n", None, "", "a: b\\", "\\e\\c"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant"] * 3, texts))] + [(2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (3, 0, None, "x")]
    got = {r["conv_id"]: r for r in chat.chat_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = "".join(f"{r}\n{x or ''}\n" for r, x in zip(["user", "assistant"] * 3, texts))
    for c in (1, None):
        assert got[c]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[c]["valid"] and got[c]["n_turns"] == 6
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(x or "" for x in texts[1::2]).encode()).hexdigest()
    assert got[2]["n_turns"] == 2 and not got[2]["valid"] and got[2]["loss_chars"] == 10 and not got[3]["valid"]


def test_templates_tell_turns_apart(spark):
    """Random marks, and texts made of parts of them: what the template accepts reads back as it was."""
    rng = random.Random(8)
    made = [chat.Template(head="<|", colon="|>", tail="</s>\n"), chat.Template(head="", colon="=", tail=";")]
    while len(made) < 25:
        mark = lambda: "".join(rng.choice("<>|/# :s\n*.[") for _ in range(rng.randint(1, 4)))
        try:
            made.append(chat.Template(head=mark(), colon=mark(), tail=mark()))
        except ValueError:
            pass
    for template in made:
        parts = [template.head, template.colon, template.tail, "\\", "x", " ", *template.head, *template.colon, *template.tail, *[x for _, x in template.escapes]]
        text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        rows = [(c, t, text(), text()) for c in range(12) for t in range(4)] + [(99, 0, "user", f"x{template.tail}{template.head}assistant{template.colon}y")]
        done = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1), template)
        for r in done.select("conv_id", chat.read_turns(chat.formatted_text(F.col("segments")), template).alias("back")).collect():
            assert [(t["role"], t["text"]) for t in r["back"]] == [(x, y) for c, _, x, y in rows if c == r["conv_id"]], template
    for head, colon, tail in (("#", "a", "aba"), ("#", ":", "a\\"), ("#", "", "x"), ("<", ":", "</s>"), ("#", "ab", "xa")):
        with pytest.raises(ValueError):
            chat.Template(head=head, colon=colon, tail=tail)


def test_chat_odd(spark):
    kind = "conv_id long, turn long, role string, text string, segments string"
    assert chat.chat_digest(spark.createDataFrame([], kind)).count() == 0
    long = "é: ### " * 30_000
    got = chat.chat_digest(spark.createDataFrame([(1, 0, "user", "q", "clash"), (1, 1, "assistant", long, "clash")], kind)).first()
    assert got["loss_chars"] == len(long) and got["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got["valid"]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, odd, none, keep):
    many = odd.unionByName(spark.range(100, 1300).selectExpr("id as doc_id", "concat('hot ', if(id % 3 = 0, id, 7)) as text", "'' as lang", "'' as source", "id as n_chars", "'' as h"))
    rows = exact_dedup.group_copies(many, keep=keep, least_hot=50).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in many.collect()]
    best = max if keep == "largest" else min
    assert len(rows) == len(texts)
    for r in rows:
        same = [i for i, t in texts if t == r["norm"]]
        assert r["group_size"] == len(same) and r["keep_id"] == best((i for i in same if i is not None), default=None)
        assert r["text_sha256"] == hashlib.sha256(r["norm"].encode()).hexdigest()
    assert sum(r["kept"] for r in rows) == len({t for _, t in texts})
    assert exact_dedup.group_copies(none).count() == 0


def brute_components(texts: dict, width: int, percent: int) -> dict:
    import re

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 1500), (5, 80, 1500), (3, 70, 8)])
def test_ngram_join(spark, width, percent, block):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([2, 4, 30, 60, 200]))] for _ in range(12)]
    texts = {1: None, 2: "", 3: " \n", 4: "one", 5: "ONE", 6: "one two"}
    for k in range(10, 150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 50)}"
        texts[k] = " ".join(words)
    got = ngram_join.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width, percent, block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, width, percent)


def test_ngram_join_odd(odd, none):
    rows = ngram_join.similar_groups(odd).collect()
    assert len(rows) == len(ODD) and sum(r["n_shingles"] == 0 for r in rows) == 3
    assert ngram_join.similar_groups(none).count() == 0


def packed(limits, want, **options):
    """Pieces by sequence: (offset, length, loss-bearing tokens) of each, all of them in order and nothing twice."""
    packer, out = packing.Packer(limits, **options), []
    for k, (n, loss) in want.items():
        out += packer.add(k, np.arange(n, dtype="<u4").tobytes(), loss)
    out += packer.finish()
    at, sequences = dict.fromkeys(want, 0), {}
    for key, start, ids, number, offset in sorted(out, key=lambda x: (x[0], x[1])):
        length = len(ids) // 4
        assert start == at[key] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length)) and length > 0
        at[key] += length
        n, loss = want[key]
        sequences.setdefault(number, []).append((offset, length, max(0, start + length - max(start, n - loss))))
    assert all(at[k] == n for k, (n, _) in want.items())
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _, _ in pieces] == np.cumsum([0, *[n for _, n, _ in pieces]])[:-1].tolist()
        total, loss = sum(n for _, n, _ in pieces), sum(x for _, _, x in pieces)
        assert total <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss_tokens
        assert total == limits.tokens or total & (total - 1) == 0
    return sequences


def test_packer_limits():
    rng = random.Random(3)
    sizes = [rng.choice([1, 3, 50, 200, 256, 900]) for _ in range(500)]
    packed(packing.Limits(tokens=256, segments=5, loss_tokens=100, window=64), {k: (n, rng.randint(0, n)) for k, n in enumerate(sizes)})
    packed(packing.Limits(), {0: (100_000, 75_000), 1: (1, 0), 2: (1, 1), 3: (2048, 2048)})


def test_dot_product_decides():
    """Prompts, then answers: by the dot product each sequence has one of both; by size alone prompts go together, and every
    answer fills the loss limit of a sequence that is half empty."""
    want = {k: (64, 64 if k >= 200 else 0) for k in range(400)}
    limits = packing.Limits(tokens=128, segments=4, loss_tokens=64, window=500)
    assert len(packed(limits, want)) == 200 and len(packed(limits, want, by_size=True)) == 300


def test_packing(odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack_documents(odd, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    for i, t in ODD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = [r for r in rows if r["doc_id"] == i]
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
        assert sum(r["length"] for r in own) == len(ids) * sum(x == i for x, _ in ODD)
    totals = {}
    for r in rows:
        totals[r["sequence_id"]] = totals.get(r["sequence_id"], 0) + r["length"]
    assert all(n & (n - 1) == 0 and n <= 2048 for n in totals.values())
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_byte_bpe(odd, none, monkeypatch):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, decode = byte_bpe.TextEncoder(byte_bpe.merges_of_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN), byte_bpe.Decoder(ranks)
    rng = random.Random(9)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(" \n\tab'!é1日\x1c") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["ab" * 20_000, "z" * 9999]
    for run in (12 << 20, 3000):  # runs end within long texts too
        monkeypatch.setattr(byte_bpe, "RUN_BYTES", run)
        ids, at = own.texts(pa.array([*texts, None], pa.string()))
        for k, t in enumerate([*texts, ""]):
            assert ids[at[k] : at[k + 1]].tolist() == want.encode_ordinary(t) and decode(ids[at[k] : at[k + 1]])[0].tobytes() == t.encode()
    rows = byte_bpe.encode_documents(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for _, t in ODD)
    assert byte_bpe.encode_digest(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_hilbert(odd, none, tmp_path):
    for bits, n in ((3, 2), (2, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        index = sharding.hilbert_index(grid, bits)
        path = grid[np.argsort(index)]
        assert sorted(index.tolist()) == list(range(len(grid))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    rows = sharding.hilbert_shards(odd, shards=5).collect()
    counts = np.bincount([r["shard"] for r in rows], minlength=5)
    assert len(rows) == len(ODD) and counts.max() - counts.min() <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in range(5))
    assert sharding.hilbert_shards(none).count() == 0


def test_shards_by_whole_values(spark, tmp_path):
    """Values that agree in their first bytes still have cells of their own: a filter on one of them reads few shards."""
    rows = [(k, "x" * (k * 37 % 900), ["en", "de", "fr", None][k * 7 % 4], f"https://site{k * 13 % 16}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = sharding.hilbert_shards(docs, shards=40).cache()
    for r, (k, text, _, _) in zip(sorted(placed.collect()), rows):
        assert (r["doc_id"], r["size"], r["text_crc32"]) == (k, len(text) + 16, zlib.crc32(text.encode()))
    both = placed.join(docs, "doc_id")
    read = lambda where: both.where(where).select("shard").distinct().count()
    assert read("source = 'https://site7'") <= 15 and read("lang = 'de'") <= 20 and read("lang is null") <= 20
    assert read("size < 50") <= 15 and read("source = 'https://site7' and lang = 'de'") <= 5
    sharding.write_shards(docs.withColumn("shard_note", F.lit("clash")), placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("doc_id").distinct().count() == 4000 and back.where("shard = 3").count() == 100
    cells = sharding.string_splitters(docs, "source", 4)  # more values than cells: runs of them
    assert cells == sorted(cells) and 2 <= len(cells) <= 4 and cells[0] == "https://site0"


def test_language_filters_by_brute_force():
    """Masks and shares of 70 languages, two words of bits, against sets of n-grams and counts one by one."""
    rng = random.Random(5)
    letters = [chr(c) for c in range(97, 123)] + list("éñöß")
    names = [f"l{k:02}" for k in range(70)]
    words = {n: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(6)] for n in names}
    texts, langs = zip(*[(" ".join(rng.choice(words[n]) for _ in range(12)), n) for n in names for _ in range(4)])
    filters = language_id.fit(list(texts), list(langs))
    assert filters.languages == names and filters.masks.shape[1] == 2

    def grams(text):
        data, starts = common.text_bytes(pa.array([text]))
        return np.concatenate([language_id.ngrams(data, starts, w)[0] for w in language_id.WIDTHS])

    held = {n: {g for g, c in __import__("collections").Counter(g for t, x in zip(texts, langs) if x == n for g in set(grams(t).tolist())).items() if c >= 2} for n in names}
    data, starts = common.text_bytes(pa.array(texts[:40]))
    shares = filters.shares(data, starts)
    for k, text in enumerate(texts[:40]):
        every = grams(text)
        masks = filters.containing(every)
        for j, n in enumerate(names):
            found = [bool(masks[i, j // 64] >> np.uint64(j % 64) & np.uint64(1)) for i in range(len(every))]
            assert all(f for f, g in zip(found, every.tolist()) if g in held[n])  # no n-gram is missed
            expected = len(every) * filters.false_rate[j]
            assert abs(shares[k, j] - min(1, max(0, (sum(found) - expected) / (len(every) - expected)))) < 1e-9
    assert [names[j] for j in shares.argmax(axis=1)] == list(langs[:40])


def test_language_id(spark, odd, none):
    rng = random.Random(1)
    words = {"en": ["the", "thing", "other", "with"], "de": ["schön", "der", "und", "ich"], "fr": ["être", "le", "que", "vous"]}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(20)), x) for k, x in enumerate(rng.choices(list(words), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df).join(df, "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd).collect()}
    assert [pred[k] for k in (1, 2, 3, 10)] == ["und"] * 4 and pred[4] == "xx"
    assert language_id.identify(none).count() == 0 and language_id.identify(odd.where("doc_id < 3")).count() == 2


def test_media(odd, none):
    rng = random.Random(2)
    for n in [0, 1, 64, 162, 176, 184, 4096, 4097, 100_000, *[rng.randint(0, 20_000) for _ in range(60)]]:
        payload = media_ts.padded(rng.randbytes(n))
        media = media_ts.mux(payload)
        back = media_ts.demux(media)
        assert b"".join(u for s in back.streams for u in s.units) == payload and not back.damaged and not any(s.breaks for s in back.streams)
    assert media_ts.demux(media[: 188 * 4] + media[188 * 5 :]).streams[0].breaks == 1
    assert media_ts.demux(media + media[-188:]).streams[0].breaks == 0
    assert media_ts.demux(b"").streams == [] and media_ts.demux(b"junk" * 100).damaged
    texts = sorted((t or "").encode() for _, t in ODD)
    got = sorted(media_ts.media_digest(odd).collect(), key=lambda r: (r["n_bytes"], r["payload_sha256"]))
    for r, text in zip(got, sorted(texts, key=lambda t: (len(t), hashlib.sha256(media_ts.padded(t)).hexdigest())), strict=True):
        payload, media = media_ts.padded(text), media_ts.mux(media_ts.padded(text))
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(text), max(64, -(-len(text) // 64) * 64), len(media))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["feature"] == media_ts.describe(media_ts.demux(media))
    assert media_ts.media_digest(none).count() == 0
    assert sorted(b"".join(bytes(u["bytes"]) for u in r["units"]) for r in media_ts.media_column(odd).collect()) == sorted(map(media_ts.padded, texts))


def section_packets(pid, sections, room=184):
    """Sections in packets of `room` bytes of data, the first one begun by a pointer."""
    data, out = b"\0" + b"".join(sections), []
    for k in range(0, len(data), room):
        part = data[k : k + room]
        stuff = 184 - len(part)
        field = b"" if not stuff else bytes([stuff - 1]) + (b"\0" + b"\xff" * (stuff - 2) if stuff > 1 else b"")
        out.append(struct.pack(">BHB", 0x47, (0x4000 if k == 0 else 0) | pid, (0x30 if stuff else 0x10) | (k // room & 15)) + field + part)
    return b"".join(out)


def program_map(program, streams, version=0):
    body = struct.pack(">HH", 0xE100, 0xF000) + b"".join(struct.pack(">BHH", kind, 0xE000 | pid, 0xF003) + b"abc" for pid, kind in streams)
    head = struct.pack(">BHHBBB", 2, 0xB000 | len(body) + 9, program, 0xC1 | version << 1, 0, 0) + body
    return head + struct.pack(">I", media_ts.mpeg_crc(head))


@pytest.mark.parametrize("room", [184, 100, 7])
def test_media_tables_over_packets(room):
    """A map of 60 streams takes several packets, whatever their size; its latest version holds; damaged ones don't."""
    body = struct.pack(">HHHH", 0, 0xE010, 1, 0xF000)  # the network's table, then a program
    head = struct.pack(">BHHBBB", 0, 0xB000 | len(body) + 9, 1, 0xC1, 0, 0) + body
    programs = section_packets(0, [head + struct.pack(">I", media_ts.mpeg_crc(head))])
    old, new = [(0x200 + k, 0x1B) for k in range(60)], [(0x300 + k, 0x0F) for k in range(50)]
    damaged = bytearray(program_map(1, old, 2))
    damaged[20] ^= 1
    kinds = lambda *sections: [(s.pid, s.kind) for s in media_ts.demux(programs + section_packets(0x1000, sections, room)).streams]
    assert kinds(program_map(1, old)) == old
    assert kinds(program_map(1, old), program_map(1, new, 1), bytes(damaged)) == new


def test_media_finds_its_way_back():
    payload = media_ts.padded(random.Random(1).randbytes(60_000))
    media = media_ts.mux(payload)
    whole = media_ts.demux(media)
    for broken in (media[:5000] + b"123" + media[5000:], media[:5000] + media[5003:], b"\x47x" + media):
        back = media_ts.demux(broken)
        same = sum(u in whole.streams[0].units for u in back.streams[0].units)
        assert back.damaged and same >= len(whole.streams[0].units) - 2
    announced = bytearray(media[: 188 * 4] + media[188 * 5 :])
    at = next(k for k in range(188 * 4, len(announced), 188) if announced[k + 3] & 0x20)
    cut = media[: 188 * 3] + bytes(announced[at:])
    assert media_ts.demux(cut).streams[0].breaks
    announced[at + 5] |= 0x80
    assert media_ts.demux(media[: 188 * 3] + bytes(announced[at:])).streams[0].breaks == 0
    scrambled = bytearray(media)
    scrambled[188 * 5 + 3] |= 0x80
    assert media_ts.demux(bytes(scrambled)).damaged == 1


def test_toxicity(spark, odd, none):
    rng = random.Random(4)
    rows = [(k, " ".join([rng.choice(["calm", "sea", "hill", "tree", "road"]) for _ in range(30)] + (["vile", "grim"] * rng.randint(1, 3) if k % 5 == 0 else []))) for k in range(400)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)] + [(7, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.grade_toxicity(df, labels).collect()
    assert all(r["toxic"] == (r["doc_id"] % 5 == 0) for r in got)
    few, many = ([r["severity"] for r in got if dict(rows)[r["doc_id"]].count("vile") == n] for n in (1, 3))
    assert max(few) < max(many) <= 2
    assert not any(r["toxic"] for r in toxicity.grade_toxicity(odd, labels.where("toxic = 0")).collect()) and toxicity.grade_toxicity(none, labels).count() == 0


def test_toxicity_likelihood_by_brute_force():
    """The fitted weights and thresholds are where the written-out likelihood is highest: no small step betters it."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["sea", "hill", "tree", "vile", "grim"], 12, p=[0.3, 0.3, 0.3, t * 0.08 + 0.01, 0.09 - t * 0.08])) for t in (rng.random(300) < 0.4).astype(int)]
    toxic = np.array([t.count("vile") > t.count("grim") for t in texts]) ^ (rng.random(300) < 0.1)
    rows = toxicity.word_counts(pa.array(texts))
    model = toxicity.fit(rows, toxic, least_ratio=1.0, steps=3000, l2=0.0)
    assert len(model.words) and model.thresholds[0] < model.thresholds[1]

    def score(weights, text):
        h, n = text
        return sum(w * np.log1p(float(n[h == x][0])) for x, w in zip(model.words, weights) if (h == x).any())

    # of the threshold that separates toxic from clean texts; both kinds weigh alike
    def likelihood(weights, threshold):
        p = np.array([1 / (1 + np.exp(threshold - score(weights, t))) for t in rows])
        return np.log(p[toxic]).mean() + np.log(1 - p[~toxic]).mean()

    p = model.exceed(np.array([score(model.weights, t) for t in rows]))
    assert (p[:, 0] >= p[:, 1]).all()
    best = likelihood(model.weights, model.thresholds[0])
    assert best > likelihood(np.zeros(len(model.weights)), 0.0) + 0.2
    assert all(best > likelihood(model.weights, model.thresholds[0] + step) for step in (0.7, -0.7))


def test_attention():
    rng = np.random.default_rng(1)
    m = attention.start(rng.integers(1, 99, 100).astype(float))
    scorer, before = attention.Scorer(m), rng.integers(0, 100, 30)
    ids = np.concatenate([np.append(before, k) for k in range(100)])
    whole = attention.score_texts(scorer, ids, np.arange(0, 31 * 101, 31), block=7)
    assert abs(np.sum(10 ** (whole - attention.score_texts(scorer, before, np.array([0, 30]))[0])) - 1) < 1e-4
    inputs, targets, _ = attention.windows(ids, np.array([0, 31, 62]), m.pad, np.arange(4))
    _, g = attention.gradients(m, inputs, targets)
    for k, v in m.p.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), v.shape)
        was, loss = v[i], []
        for step in (1e-2, -1e-2):
            v[i] = was + step
            loss.append(attention.gradients(m, inputs, targets)[0])
        v[i] = was
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k][i]) < 2e-3 + 0.1 * abs(g[k][i])
    # a constant on all logits changes nothing, but their exponentials overflow or vanish unless they are shifted
    loss, g = attention.gradients(m, inputs, targets)
    for by in (200, -200):
        far = attention.Model(m.place, {k: v + np.float32(by) if k in ("cb", "mb", "near") else v for k, v in m.p.items()})
        with np.errstate(all="ignore"):
            assert attention._slopes(far, inputs, targets, shift=False) is None
        far_loss, far_g = attention.gradients(far, inputs, targets)
        assert abs(far_loss - loss) < 1e-3 and all(np.allclose(far_g[k], g[k], atol=1e-3) for k in g)
    none_loss, none = attention.gradients(m, inputs, np.full_like(targets, -1))
    assert none_loss == 0 and all(not x.any() for x in none.values())


def test_lm_base(spark, odd, none):
    from collections import Counter

    train = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    few = lambda df: language_model.score(df, train, P.path("byte_bpe_50k.tiktoken"), 512, steps=20)
    rows = few(odd).collect()
    words = [(i, [*(t or "").split(), "\0"]) for i, t in ODD]
    c = Counter(w for i, ws in words if i is not None and i % 2 == 0 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in words)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 and r["train_tokens"] == n for r in rows) and few(none).count() == 0


def test_lm_trains_on_every_text(spark):
    """The first model is one that has seen nothing; all that is learned comes from the pass over every text."""
    path = P.path("byte_bpe_50k.tiktoken")
    texts = [f"short text number {k}" for k in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(20)
    data, starts = common.text_bytes(pa.array(texts))
    ids, begins = language_model.subwords_of(path, 512).texts(language_model.words_of(data, starts))
    score = lambda m: attention.score_texts(attention.Scorer(m), ids, begins).mean()
    first = attention.start(np.zeros(513), 11)
    assert score(language_model.train(rows, first, path, 512)) > score(first) + 0.01


def test_lm_reads_its_texts_four_times(spark, tmp_path):
    """For their sizes, the sample, training and scoring."""
    log = str(tmp_path / "reads")

    def read(batches):
        with open(log, "a") as f:
            for b in batches:
                f.write("x" * b.num_rows)
                yield b

    docs = spark.createDataFrame([(k, f"some text number {k}") for k in range(50)], "doc_id long, text string").coalesce(1).mapInArrow(read, "doc_id long, text string")
    assert language_model.score(docs, F.col("doc_id") % 5 != 1, P.path("byte_bpe_50k.tiktoken"), 512, steps=5).count() == 50
    assert len(open(log).read()) <= 4 * 50


def test_windows_are_runs_of_their_texts():
    rng = np.random.default_rng(4)
    starts = np.cumsum([3, 1, 2, 17, 18, 40, 1, 100])
    ids = rng.integers(0, 99, starts[-1] + 5)
    found = attention.Windows(ids, starts, 100)
    want = []
    for k, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        for first in range(0, hi - lo - 1, attention.FRESH):
            row = [ids[lo + t] if 0 <= t < hi - lo else 100 for t in range(first - attention.CONTEXT, first + attention.FRESH + 1)]
            want.append((k, row[:-1], [-1 if x == 100 else x for x in row[attention.CONTEXT + 1 :]]))
    inputs, targets = found.at(np.arange(len(found)))
    assert [(k, i, t) for k, i, t in zip(found.text.tolist(), inputs.tolist(), targets.tolist())] == want


def test_lm_scores_by_the_definition():
    """Batched windows against attention written out for one position after another."""
    rng = np.random.default_rng(3)
    m = attention.start(rng.integers(1, 99, 100).astype(float))
    p, ids = {k: v.astype(float) for k, v in m.p.items()}, rng.integers(0, 100, 75)
    want = 0.0
    for t in range(len(ids) - 1):  # predicts ids[t + 1]
        first = t // attention.FRESH * attention.FRESH - attention.CONTEXT  # of the window; before the text there are pads
        seen = [ids[s] if s >= 0 else m.pad for s in range(first, t + 1)]
        logits = np.array([p["q"][ids[t]] @ p["k"][x] / np.sqrt(attention.KEY) + p["near"][t - s] for s, x in zip(range(first, t + 1), seen)])
        weights = np.exp(logits - logits.max())
        weights /= weights.sum()
        h = np.maximum(0, sum(w * p["v"][x] for w, x in zip(weights, seen)) + p["r"][ids[t]] + p["rb"])
        c, member = divmod(int(m.place[ids[t + 1]]), attention.CLASS)
        for logit, k in ((h @ p["cw"] + p["cb"], c), (h @ p["mw"][c] + p["mb"][c], member)):
            want += logit[k] - np.log(np.exp(logit).sum())
    assert abs(attention.score_texts(attention.Scorer(m), ids, np.array([0, 75]), block=2)[0] - want / np.log(10)) < 1e-4


def test_lm_beats_its_base(spark):
    """On held-out texts of a language in which each of 40 words has two that may follow it."""
    rng = random.Random(2)
    names = ["".join(rng.choice(["ba", "ko", "ri", "mu", "ten", "sol"]) for _ in range(2 + k % 2)) + "qxz"[k % 3] for k in range(40)]
    after = {w: rng.sample(names, 2) for w in names}

    def text():
        words = [rng.choice(names)]
        while len(words) < 60:
            words.append(rng.choice(after[words[-1]]))
        return " ".join(words)

    rows = [(k, text()) for k in range(400)]
    got = language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 != 1, P.path("byte_bpe_50k.tiktoken"), 512, steps=400)
    for held_out in (True, False):
        score, base = got.where(F.col("held_out") == held_out).agg(F.sum("score"), F.sum("base_score")).first()
        assert score > 0.8 * base  # by a fifth at least


def test_words_that_a_weak_hash_confuses(spark):
    """Thue-Morse words, which polynomial hashes modulo a power of two take for each other."""
    for n in (64, 1024, 4096):
        a = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        data, starts = common.text_bytes(pa.array([a, b, a.upper()]))
        h, _ = common.word_hashes(data, starts)
        assert h[0] == h[2] != h[1]
    rows = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(rows).collect()} == {1: 1, 2: 2, 3: 1}


SPACES = ["a \u00a0 \u00a0 c", *["a" + " \u00a0" * k + " c" for k in (1, 4, 8)], "a\u00a0 c", "\u00a0 c", " \u00a0 ", "a\t \n b", "\n \n x", "a \t b \r\n ", " \u3000 \u2028 y", "a\x1c \x1c b", "  a  b  ", " ", ""]


def test_white_space_around_single_spaces(spark):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    texts = SPACES + ["".join(rng.choice(" \u00a0\t\n\x85\x1fab1'") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, at = byte_bpe.TextEncoder(byte_bpe.merges_of_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).texts(pa.array(texts))
    assert all(ids[at[k] : at[k + 1]].tolist() == want.encode_ordinary(t) for k, t in enumerate(texts))


def test_both_queues_agree():
    """The queue of many pre-tokens and the one of a single pre-token, against the definition: the lowest rank, leftmost."""
    rng = random.Random(6)
    merges = byte_bpe.merges_of_ranks(P.path("byte_bpe_multi_50k.tiktoken"))

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            ranks = [merges.whole.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 40:
                return [merges.whole[p] for p in parts]
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = list({"".join(rng.choice("aaabnr tionéü") for _ in range(rng.randint(1, 60))).encode() for _ in range(800)})
    starts = np.cumsum([0, *map(len, words)])
    ids, at = byte_bpe.RankQueue(merges, np.frombuffer(b"".join(words), np.uint8), starts).run()
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == byte_bpe.merge_long(merges, w) == plain(w)


def test_language_id_of_long_texts(spark):
    rows = [(k, x * 3000, x.split()[0]) for k, x in enumerate(["the other ", "schon ich "] * 4)] + [(8, "the other", "the"), (9, "schon ich", "schon"), (10, "?!", None)]
    pred = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("length(text) > 20000 or doc_id = 8").unionByName(spark.createDataFrame([(20, "schon ich", None)], "doc_id long, text string, lang string"))).collect()}
    assert pred[20] == "schon" and pred[8] == "the"
