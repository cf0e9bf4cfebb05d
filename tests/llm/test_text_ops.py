import datetime
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from demandlens.llm import counts, encoding, language, mixing, pii, simhash, store, transport
from tests.llm.conftest import TEXTS
from tests.llm.near_copies import kept_ids, with_copies

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- operator 1


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for size in (1, 2, 10, 97, 1000):
        seen = [f.permute(x, size, "t") for x in range(size)]
        assert sorted(seen) == list(range(size))
        assert [f.permute(x, size, "t", back=True) for x in seen] == list(range(size))
    assert [f.permute(x, 1000, "t") for x in range(5)] != [pii.Feistel(b"j").permute(x, 1000, "t") for x in range(5)]


def test_pseudonyms_keep_formats_and_return():
    there, back = pii.Pseudonyms(b"secret"), pii.Pseudonyms(b"secret", back=True)
    values = ["4539 1488 0343 6467", "4539148803436467", "123-45-6789", "2021-02-28", "12/31/1999", "31/12/1999", "28.02.2021", "10.0.200.7",
              "+1 (743) 555-3824", "+33 6 12 34 56 78", "hein.19@mail5.example.com", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    for value in values:
        new, spans = there.text(f"see {value} here")
        assert len(spans) == 1, value
        assert value not in new
        assert back.text(new)[0] == f"see {value} here", value
        kind, at, n = spans[0]
        got = new[at : at + n]
        if kind != "ip":
            assert len(got) == len(value) and [c.isdigit() for c in got] == [c.isdigit() for c in value] or kind == "iban"
        if kind == "card":
            assert luhn(got.replace(" ", ""))
        if kind == "iban":
            assert pii._iban_rest(got.replace(" ", "")[4:] + got[:4]) == 1
    assert there.text("2021-02-28")[0].count("-") == 2
    datetime.date.fromisoformat(there.text("2021-02-28")[0])
    for plain in ("4539148803436468", "2021-02-30", "999.1.1.1", "000-12-1234", "version 1.2.3", "DE00370400440532013000", "1234"):
        assert there.text(plain) == (plain, []), plain


def test_values_beside_other_numbers():
    there, back = pii.Pseudonyms(b"secret"), pii.Pseudonyms(b"secret", back=True)
    card = "4111 1111 1111 1111"
    for text in (f"paid with {card} 12/25 today", f"card {card} 123, thanks", f"order 12 {card} was sent", f"order 12345678 {card}.", f"{card} 5500 0000 0000 0004"):
        new, spans = there.text(text)
        assert card not in new and "5500 0000" not in new and {k for k, _, _ in spans} == {"card"}, text
        at, n = spans[0][1:]
        assert luhn(new[at : at + n].replace(" ", "")) and new[:at] == text[:at], text
    for value in ("3/14/2021", "1.5.2020", "2021-3-4", "31/1/1999", "3/04/2021", "13/5/2020", "9-9-2019"):
        new, spans = there.text(f"born on {value}, they say")
        assert [(k, a, n) for k, a, n in spans] == [("date", 8, len(value))] and value not in new, value
        assert back.text(new)[0] == f"born on {value}, they say", value
    shape = {there.text(f"{m}/{d}/{y}")[0] for y in (2020, 2021) for m in range(1, 10) for d in range(10, 29)}
    assert len(shape) == 2 * 9 * 19 and all(len(x) == 9 for x in shape)


@pytest.mark.parametrize("value", ['"' + "0123456789abcdef" * 1250 + '"', "ab1" * 3334 + "@x.example.com"])
def test_long_values(spark, value):
    there, back = pii.Pseudonyms(b"secret"), pii.Pseudonyms(b"secret", back=True)
    made = pii.pseudonymise(spark.createDataFrame([(1, value, "x")], "doc_id long, text string, kinds string"), b"secret").first()
    new, spans = there.text(value)
    assert made["text"] == new != value and len(spans) == 1 and len(new) == len(value) and back.text(new)[0] == value


def test_no_place_of_a_secret_is_kept():
    """Over 1600 secrets of 512 digits, none of the digits' places stays more often than one in 16 does by chance."""
    names, rng, kept = pii.Pseudonyms(b"secret"), random.Random(8), np.zeros(512)
    for _ in range(1600):
        value = f"{rng.getrandbits(2048):0512x}"
        new = names.text(f'"{value}"')[0][1:-1]
        kept += [a == b for a, b in zip(value, new, strict=True)]
    assert kept.max() < 100 + 6 * (1600 / 16) ** 0.5 and 0.9 * 1600 / 16 < kept.mean() < 1.1 * 1600 / 16


def test_letters_of_all_planes(spark):
    rows = [(k, "ab cd ef", "en") for k in range(40)] + [(100, "\U00032000\U000323af", None), (101, "\U0001f600", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "en" and got[101] == "und"


def test_languages_equal_brute_force(spark):
    """The posterior of naive Bayes over 1- to 3-grams, counted without numpy."""
    from math import exp, log

    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat sat", "en"), ("le chat noir", "fr"), ("a dog ran", "en"), ("un chien brun", "fr"), ("cat", "fr"), ("Zut, alors 12", "en")] * 3)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=13)
    count = {g: [{}, {}, {}] for g in ("en", "fr")}

    def grams(text):
        buckets, starts, _ = language.features([text], 13)
        return [[int(b) for b in found if b] for found in buckets]

    for _, text, g in rows:
        for n, found in enumerate(grams(text)):
            for b in found:
                count[g][n][b] = count[g][n].get(b, 0) + 1
    for text in ("the chat", "dog", "noir un"):
        logs = {}
        for g in count:
            logs[g] = log(sum(x[2] == g for x in rows) / len(rows))
            for n, found in enumerate(grams(text)):
                total = sum(count[g][n].values())
                logs[g] += sum(log((count[g][n].get(b, 0) + 0.5) / (total + 0.5 * (2**13 - 1))) for b in found)
        best = max(logs, key=logs.get)
        pred, score = model.predict([text])
        assert pred == [best] and score[0] == pytest.approx(1 / sum(exp(x - logs[best]) for x in logs.values()), rel=1e-4)


def test_pseudonyms_link_documents(spark, docs, no_docs):
    made = spark.createDataFrame([(1, "mail a.b@x.example.com and 10.1.2.3"), (2, "again 10.1.2.3"), (None, "10.1.2.3"), (4, None)], "doc_id long, text string")
    found = pii.pseudonymise(made, b"k")
    linked = {r["kind"]: r for r in pii.linked_values(found).collect()}
    assert linked["ip"]["n_documents"] == 3 and linked["ip"]["n_uses"] == 3
    assert pii.pseudonymise(no_docs, b"k").count() == 0
    plain = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, b"k").collect()}
    assert plain[1] == TEXTS[0][1] and plain[5] is None and len(plain) == 12


# --- operator 2


def reference_fingerprint(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_groups(prints, distance):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(prints)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("wide", [False, True])
def test_simhash_groups_equal_brute_force(spark, wide):
    from demandlens.session import table

    docs = table(spark, DATA, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {d: reference_fingerprint(t) for d, t in texts.items()}
    groups = reference_groups(set(prints.values()), 4)
    least = {}
    for d in sorted(prints):
        least.setdefault(groups[prints[d]], d)
    want = {(d, f"{p:016x}", least[groups[p]]) for d, p in prints.items()}
    got = simhash.near_duplicates(docs, wide=wide).collect()
    assert {(r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got} == want


@pytest.mark.parametrize(("distance", "wide"), [(4, False), (4, True), (0, False)])
def test_dense_and_chained_fingerprints(spark, distance, wide):
    rng = random.Random(distance)
    center, fps = rng.getrandbits(63), []
    for _ in range(60):
        x = center
        for b in rng.sample(range(63), rng.randint(0, 5)):
            x ^= 1 << b
        fps.append(x)
    chain = rng.getrandbits(63)
    for k in range(0, 40, 3):
        chain ^= 0b111 << k
        fps.append(chain)
    fps += [rng.getrandbits(63) for _ in range(40)] + [0, 1, 15]
    groups = reference_groups(set(fps), distance)
    got = simhash.cluster(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, wide).collect()
    by = {}
    for r in got:
        by.setdefault(r["root"], set()).add(r["fp"])
    want = {}
    for f, g in groups.items():
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_simhash_edges(docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["fp"] == by[5]["fp"] == by[6]["fp"] == 0 and by[6]["component_id"] == 4
    assert by[2]["component_id"] == 1 and by[None]["component_id"] is None
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert 2 not in kept and kept.count(3) == 1 and None in kept


def test_marks_differ_less_than_sets():
    rng = np.random.default_rng(8)
    for size, other in [(1, 1), (3, 40), (150, 130), (150, 0), (4000, 3000)]:
        common = rng.integers(0, 1 << 64, rng.integers(0, 200), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 64, n, dtype=np.uint64)])) for n in (size, other))
        apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(simhash.marks(a).view(np.uint64), simhash.marks(b).view(np.uint64), strict=True))
        assert len(simhash.marks(a)) == simhash.MARKS and apart <= len(set(a.tolist()) ^ set(b.tolist()))
    assert sum(int(x).bit_count() for x in simhash.marks(np.array([5], dtype=np.uint64)).view(np.uint64)) == 1


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_one_of_each_near_copy(spark, monkeypatch, crowd):
    """Edited copies of the table's texts, short texts that share most of their shingles, and a group of similar texts; crowded keys are split."""
    from demandlens.session import table

    monkeypatch.setattr(simhash, "CROWD", crowd)
    texts = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect() if r["text"] and len(r["text"]) < 4000]
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    group = []
    for k in range(40):
        some = list(base)
        for _ in range(rng.randint(2, 9)):
            some[rng.randrange(150)] = f"x{rng.randrange(999)}"
        group.append((5_000_000 + k, " ".join(some)))
    short = [(6_000_000 + k, " ".join([*base[:k], f"end{k % 3}"])) for k in range(1, 30)]
    made = with_copies(texts[:80], 3) + group + short + short[:5]
    got = [r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got) == kept_ids(made)


def test_keys_of_many_labels_ask_for_other_pivots(spark):
    """Pairs of different labels count, not rows of one."""
    filed = lambda labels: spark.createDataFrame([(1, x) for x in labels] + [(2, 0), (2, 1)], "key long, label long")
    assert simhash._dense(filed(range(20))) and not simhash._dense(filed([7] * 20)) and not simhash._dense(filed([1, 2]).limit(0))


# --- operators 3 and 4


def test_encoder_equals_the_library():
    tokenizer, rng = Tokenizer.from_file(VOCABULARY), random.Random(1)
    some = ["a", " ", "  ", "\n", "\n\n", "\t", "b,", " c", "é", "<|endoftext|>", "'s", "12", "\xa0", "　", "\r\n", "_", "\x1c", "​", "中", "😀", "\u0085"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [t for _, t, _, _ in TEXTS if t]
    ids, lengths = encoding.Encoder(VOCABULARY, keep=500).encode(texts)
    ends = np.cumsum(lengths)
    for t, e, n in zip(texts, ends, lengths, strict=True):
        assert ids[e - n : e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_words_before_marks_are_looked_up(monkeypatch):
    """A word that was seen alone isn't tokenized again with a mark after it."""
    enc, tokenizer, asked = encoding.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), []
    enc.encode(["a strangeword here."])
    plain = enc._piece
    monkeypatch.setattr(enc, "_piece", lambda x: asked.append(x) or plain(x))
    ids, _ = enc.encode(["b strangeword. strangeword, é! 1. a.. ."])
    assert ids.tolist() == tokenizer.encode("b strangeword. strangeword, é! 1. a.. .", add_special_tokens=False).ids
    assert " strangeword" not in asked and "strangeword" not in asked


def test_token_store_round_trip(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = store.token_store(docs, path=f"file://{tmp_path}/s").collect()
    ids = {r["start"]: (r["doc_id"], list(r["ids"])) for r in store.read_ids(spark, f"file://{tmp_path}/s", 50257).collect()}
    want = sorted(((i, t or "") for i, t, _, _ in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for (doc_id, text), r in zip(want, sorted(got, key=lambda r: r["start"]), strict=True):
        whole = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["verified"]) == (doc_id, at, len(whole), True)
        assert r["ids_crc32"] == zlib.crc32(np.array(whole, dtype="<u4").tobytes())
        assert ids[at] == (doc_id, whole)
        at += len(whole)
    nodes = spark.read.parquet(f"file://{tmp_path}/s/manifest").where("level = 2").collect()
    assert [(r["n_documents"], r["n_tokens"]) for r in nodes] == [(len(TEXTS), at)]
    chunks = spark.read.parquet(f"file://{tmp_path}/s/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()


def test_token_store_of_no_documents(no_docs):
    assert store.token_store(no_docs).count() == 0


def test_damaged_chunk_is_told(spark, docs, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_store(docs.where("doc_id < 4"), path, VOCABULARY)
    chunks = spark.read.parquet(f"{path}/chunks").selectExpr("address", "concat(data, X'0100') AS data")
    chunks.write.parquet(f"file://{tmp_path}/t/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"file://{tmp_path}/t/recipes")
    assert {r["verified"] for r in store.read_documents(spark, f"file://{tmp_path}/t", 50257).collect()} == {False}


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    tail = rng.integers(0, 50_000, 20_000).astype("<u2")
    a, b = np.concatenate([rng.integers(0, 50_000, 777).astype("<u2"), tail]), tail
    chunks = []
    for ids in (a, b):
        cuts = store.cut_points(ids, np.array([len(ids)]))[0]
        assert cuts[-1] == len(ids) and max(np.diff([0, *cuts])) <= store.MOST
        chunks.append({ids[x:y].tobytes() for x, y in zip([0, *cuts], cuts, strict=False)})
    assert len(chunks[0] & chunks[1]) > len(chunks[1]) * 0.8


def test_joined_crc():
    a, b = b"hello there", b"general" * 9
    assert store.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert store.joined_crc(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


@pytest.mark.parametrize("rule", counts.RULES)
def test_section_counts_equal_brute_force(docs, rule):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {}
    for r in counts.section_counts(docs, rule=rule).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, _, _ in TEXTS:
        text = text or ""
        ids = tokenizer.encode(text, add_special_tokens=False)
        mine = sorted(got[doc_id], key=lambda r: (r["section"], r["char_start"]))[:: 2 if doc_id == 3 else 1]
        assert [r["char_end"] for r in mine][-1] == len(text)
        want = [0] * len(mine)
        for a, b in ids.offsets:
            where = [k for c in range(a, max(b, a + 1)) for k, r in enumerate(mine) if r["char_start"] <= c < r["char_end"]]
            want[where[0] if rule == "first" else where[-1] if rule == "last" else max(dict.fromkeys(where), key=where.count)] += 1
        if len(text) < 1000:
            assert [r["n_tokens"] for r in mine] == want, text
        assert sum(r["n_tokens"] for r in mine) == len(ids.ids)


def test_sections_of_fields_and_none(spark, no_docs):
    assert counts.section_counts(no_docs).count() == 0
    made = spark.createDataFrame([(1, "a title", "one\ntwo\n"), (2, None, None)], "doc_id long, title string, body string")
    got = sorted(rows(counts.section_counts(made, fields=("title", "body")).select("doc_id", "section", "field", "char_start", "char_end")))
    assert got == [(1, 0, "title", 0, 8), (1, 1, "body", 8, 12), (1, 2, "body", 12, 16), (2, 0, "title", 0, 1), (2, 1, "body", 1, 1)]


# --- operator 8


def test_transport_round_trip(docs, no_docs):
    import hashlib

    got = {r["doc_id"]: r for r in transport.parse_media(transport.store_media(docs)).collect()}
    for doc_id, text, _, _ in TEXTS:
        raw = (text or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-64:])
        assert r["media_bytes"] % 188 == 0 and len(r["random_access"]) == -(-len(whole) // transport.UNIT)
    assert transport.parse_media(transport.store_media(no_docs)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 100, 168, 169, 170, 182, 352, 353, 354, 1000, 32_768, 32_769, 70_000])
def test_multiplex_sizes(size):
    data = bytes(k * 7 % 256 for k in range(size))
    (s,) = transport.demultiplex(transport.multiplex(data))
    assert s.payload == data and s.discontinuities == s.duplicates == s.damaged == 0
    assert [p for p, _, _ in s.units] == [k * transport.TICKS for k in range(max(1, -(-size // transport.UNIT)))]


def test_continuity_and_damage():
    media = transport.multiplex(b"x" * 5000)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    (lost,) = transport.demultiplex(b"".join(packets[:5] + packets[6:]))
    assert lost.discontinuities == 1 and lost.damaged == 1
    (twice,) = transport.demultiplex(b"".join(packets[:5] + packets[4:]))
    assert twice.duplicates == 1 and twice.payload == b"x" * 5000 and twice.discontinuities == 0
    for bad in (b"", media[:-1], b"\0" + media[1:], b"".join(packets[2:])):
        with pytest.raises(transport.TransportError):
            transport.demultiplex(bad)
    assert transport.crc_mpeg(b"123456789") == 0x0376E6E7


def test_bad_media_rows(spark):
    made = spark.createDataFrame([(1, 3, b"abc"), (2, None, None)], "doc_id long, n_bytes long, media binary")
    got = transport.parse_media(made).collect()
    assert {r["payload_bytes"] for r in got} == {None} and all(r["feature"].startswith("error=") for r in got)


# --- operators 9 and 10


def test_language_id(spark, docs, no_docs):
    from demandlens.session import table

    known = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.language_id(known).join(known.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in language.language_id(docs).collect()}
    assert by[4] == by[5] == by[6] == by[8] == "und" and by[9] == "en"
    assert language.language_id(no_docs).count() == 0


def test_ngrams_end_with_their_text():
    texts = ["a", "bcd", "", "12", "école  x"]
    together, starts, _ = language.features(texts, 13)
    for k, text in enumerate(texts):
        alone, _, _ = language.features([text], 13)
        for n in range(3):
            assert together[n][starts[k] : starts[k] + len(text) + 2].tolist() == alone[n].tolist(), (text, n)


def test_texts_of_no_learned_language_go(spark):
    from demandlens.session import table

    known = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rng = random.Random(9)
    junk = [(-k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60))) for k in range(1, 41)]
    taught = language.train(known.where(~language.held_out(known["doc_id"])), floors=True)
    clean = known.where(language.held_out(known["doc_id"]))
    assert language.keep_confident(clean, taught, 0.5).count() >= 0.99 * language.keep_confident(clean, language.train(known.where(~language.held_out(known["doc_id"]))), 0.5).count()
    assert language.keep_confident(spark.createDataFrame(junk, "doc_id long, text string"), taught, 0.5).count() == 0


def test_mix(spark, docs, no_docs):
    import re

    from demandlens.session import table

    for made in (table(spark, DATA, "documents"), docs):
        got = mixing.mix(made).collect()
        again = sorted(map(str, mixing.mix(made).collect()))
        assert sorted(map(str, got)) == again and len(got) == made.count()
        texts = {}
        for r in made.select("doc_id", "text").collect():
            texts[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        taken, target, most, total = {}, {}, {}, {}
        for r in got:
            assert r["size"] == texts[r["doc_id"]] and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            target[r["source"]] = r["target"]
            total[r["source"]] = r["source_size"]
            most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        for s, want in target.items():
            assert want <= 3 * total[s] + 1e-6 and taken[s] <= want + 1 and want - taken[s] <= max(1, most[s])
    assert mixing.mix(no_docs).count() == 0


def brute_targets(totals, cap=3.0):
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight, open_, want, rest = {s: k % 3 + 1 for k, s in enumerate(order)}, list(order), {}, float(sum(totals.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > cap * totals[s]]
        if not full:
            return want | share
        for s in full:
            want[s] = cap * totals[s]
            open_.remove(s)
        rest = sum(totals.values()) - sum(want.values())
    return want


@pytest.mark.parametrize("totals", [{"a": 100, "b": 100, None: 100}, {"a": 1000, "b": 10}, {"z": 5, "é": 900, "b": 1, "c": 70, None: 0}, {"a": 0}])
def test_targets_equal_brute_force(spark, totals):
    got = mixing.targets(spark.createDataFrame(list(totals.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(brute_targets(totals))


def test_mixed_rows_are_those_of_the_mix(spark):
    """Repeated and null ids, over several sources, with rows alike of which a part is taken."""
    made = [(k % 7 or None, f"w{k % 5} " * (k % 4), "abc"[k % 3], k) for k in range(300)] + [(1, "same text here", "a", 0)] * 500
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, _size int").repartition(5)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    rows = mixing.mixed_rows(docs).collect()
    got = {}
    for r in rows:
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert got == taken and all(r["text"] for r in rows)
    assert {tuple(r) for r in rows} <= {tuple(r) for r in made + [(1, "same text here", "a", 0)]}
    assert 0 < sum(r["text"] == "same text here" for r in rows) % 500


def test_budgets():
    take = mixing.fit_budget(np.array([3, 5, 7]), np.array([2, 2, 2]), 19)
    assert 12 < (take * np.array([3, 5, 7])).sum() <= 19 and (take <= 2).all()
