"""The operators of the llm subpackage against brute force and on odd input: nulls, empty and long texts, ties,
repeated rows, empty tables, and extra columns with clashing names."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import forms, leakage, mixing, neardup, overlap, pairs, queries, reading, residue, setjoin, sitelines, splits
from tamarack.llm.words import words_of
from tamarack.operators import skew

VOWELS = "xin chào các bạn hôm nay trời đẹp quá chúng ta cùng đi chơi ở hồ tây nhé rồi ăn kem uống trà đá ngắm hoa sen nở đầy ao làng quê yên bình nước trong gió mát".split()


def sentence(rng, n):
    return " ".join(rng.choice(VOWELS) for _ in range(n))


def words(text):
    return re.findall(r"[^\W_]+", forms.consistent_text(text or "").lower())


def runs(ws, n=3):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


# Problem 1


@pytest.mark.parametrize(
    ("question", "answer", "kind"),
    [
        ("Hỏi gì?", None, "empty"), ("Hỏi gì?", " \n", "empty"), ("Hỏi gì?", "N/A", "empty"), ("Hỏi gì?", "<p></p>", "empty"), ("Hỏi gì?", "Trả lời:", "empty"), ("Hỏi gì?", "\u200b", "empty"),
        ("Ai có quyền cấp phép?", "Rất tiếc, tôi không thể trả lời câu hỏi này.", "refusal"), ("Ai?", "I'm sorry, but I cannot help with that request.", "refusal"),
        ("Ai có thẩm quyền cấp giấy phép xây dựng tại xã?", "Hỏi: Ai có thẩm quyền cấp giấy phép xây dựng ở tại xã?", "echo"),
        ("Tôi phải nộp hồ sơ ở đâu và khi nào?", "The applicant must submit the file to the district board.", "wrong_language"),
        ("Where must the applicant file the form?", "Người nộp đơn phải nộp hồ sơ tại xã.", "wrong_language"),
        ("Tôi phải nộp gì?", "Hồ sơ gồm:\na) Đơn xin cấp phép;\nb)", "truncated"), ("Tôi phải nộp gì?", "Bạn phải nộp đơn tại (theo Điều", "truncated"), ("Tôi phải nộp gì?", "Mức phạt được tính như sau:", "truncated"),
        ("Có mất phí không?", "Không. Việc này rất nhanh.", None), ("Tôi phải nộp gì?", "Bạn phải nộp đơn tại xã.\nTrân trọng", None), ("Tôi phải nộp gì?", "Ban phai nop don tai xa trong thoi han 5 ngay.", None),
        ("Tôi phải nộp gì?", "Bạn có quyền từ chối nộp và phải xin lỗi nếu trả chậm.", None), (None, "Bạn phải nộp đơn tại xã.", None),
    ],
)
def test_defects(question, answer, kind):
    assert pairs.defect(question, answer) == kind


def test_defects_do_not_depend_on_length():
    far = "liên quan đến thủ tục cấp giấy phép xây dựng nhà ở riêng lẻ tại nơi bạn cư trú và các giấy tờ phải nộp kèm theo "
    for n in (1, 10, 130, 1000):
        for part in (" ", ".", "<p>&nbsp;</p>", "-\n", "\u200b"):
            assert pairs.defect("Hỏi gì?", part * n) == "empty"
        assert pairs.defect("Hỏi gì?", f"Về việc bạn đang hỏi {far * (n // 10)}, tôi không thể trả lời câu hỏi này.") == "refusal"
        assert pairs.defect("Hỏi gì?", f"Về việc này {far * (n // 10)} chủ hộ phải trả lời và tôi không thể trả lời câu hỏi này thay họ.") is None
        assert pairs.defect("Hỏi gì?", "Bạn phải nộp đơn tại xã." + "\n" * n + "Trân trọng" + " ." * n) is None
        assert pairs.defect("Hỏi gì?", "Hồ sơ gồm:\na) Đơn;\nb)" + " " * n) == "truncated"
        assert pairs.defect("Hỏi gì?", "Mức phạt được tính như sau" + " " * n + ":") == "truncated"


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("Hồ sơ gồm (theo mẫu tại Điều 5.", ["("]), ('Luật gọi đó là "hành vi bị cấm.', ['"']), ('Luật gọi đó là "hành vi" bị cấm.', []), ('Ống 21" và 27".', []), ("Xem <ul><li>một.", ["<ul>", "<li>"]), ("```\nx = (1\n```", []), ("```\nx = 1.", ["```"]),
        ("a) Một;\nb) Hai.", []), ("Gồm:\na) Một;\nb)", ["item"]), ("Gồm: a) Một; b)", ["item"]), ("1. Một\n2.", ["item"]), ("Gồm:\n-", ["item"]), ("Các bước như sau:", ["list"]), ("Khoản 2) và [1] {x}.", []), ("(một [hai) ba.", []), ("“một «hai” ba.", []),
    ],
)
def test_open_structures(text, left):
    assert pairs.open_structures(text) == left
    if left:
        assert pairs.defect("Hỏi gì vậy bạn?", text) == "truncated"


def test_defective_pairs_table(spark):
    rows = [("a", "Hỏi gì?", None, 1), ("a", "Hỏi gì?", None, 2), ("b", None, "Đúng vậy.", 1), (None, "x", None, 1), ("c", "Hỏi gì?", "Bạn phải nộp đơn. " * 5000, 1)]
    df = spark.createDataFrame(rows, "id string, question string, answer string, defect int")
    assert {tuple(r) for r in pairs.defective_pairs(df).collect()} == {("a", "empty")}
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_tiling_covers_each_word_once():
    q = "a b c d e f g".split()
    assert pairs.tiled("a b c x d e f".split(), q) == 6
    assert pairs.tiled("a b x".split(), q) == 0
    assert pairs.open_structures("a (b [c] ```x``` <b>d</b> “e") == ["(", "“"]


# Problem 2


def test_consistent_form():
    same = ["(nhãn «Право») hãng κόσμος hệ số α = 0,18 m² ½ “ưu tiên” – đồng", "", "thỏa thuận"]
    for text in same:
        assert forms.consistent_text(text) == text
    changed = {"Ｋíｎｈ ｇửｉ": "Kính gửi", "Pho\u200cng": "Phong", "ðồng QƉ-ΒTX": "đồng QĐ-BTX", "a\u00a0b\u3000c": "a b c", "то\u0301i tôi": "tói tôi", "tổ hо\u0300a": "tổ hòa", "giu\u0301p": "giúp", "Прaво": "Право"}
    for text, form in changed.items():
        assert forms.consistent_text(text) == form
        assert forms.consistent_text(form) == form
    assert forms.consistent_text(None) is None


def test_transducer_composes_every_form():
    import unicodedata

    machine, rng = forms.transducer(), random.Random(2)
    assert {"e\u0302\u0301": "ế", "\u00ea\u0301": "ế", "o\u0323\u031b": "ợ", "o\u031b\u0323": "ợ"}.items() <= machine.composed.items()
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).isalpha() and chr(c) not in machine.to_latin]
    for _ in range(4000):
        plain = unicodedata.normalize("NFC", "".join(rng.choice(letters) + rng.choice(["", "", "\u0301", "\u0323\u0302", "\u0302\u0323\u0303"]) for _ in range(6)))
        if any(c in machine.to_latin or c in machine.single for c in plain):
            continue
        apart = "".join(c + rng.choice(["", "", "\u200b"]) for c in unicodedata.normalize(rng.choice(["NFC", "NFD"]), plain))
        assert machine.run(apart) == plain == machine.run(plain)
    broken = forms.Transducer()
    broken.composed["Ａ"] = "Ä"
    with pytest.raises(ValueError, match="conflicting"):
        broken._check()


def test_inconsistent_records(spark):
    df = spark.createDataFrame([("a", "Ｘin"), ("a", "Ｘin"), ("b", "xin chào"), ("c", None), ("d", ""), (None, "Ｘ")], "id string, text string").selectExpr("*", "1 AS table_name")
    assert [tuple(r) for r in forms.inconsistent_records(df, "id", "text", "t").collect()] == [("t", "a")]
    assert {r.id: r.c for r in forms.with_consistent(df, {"text": "c"}).collect() if r.id} == {"a": "Xin", "b": "xin chào", "c": None, "d": ""}


# Problem 3


def test_repeated_lines(spark):
    docs = [(f"d{i}", "s", f"Trang  chủ {i}\nNội dung {'abc'[i % 3]} riêng\n\n{'Bản quyền' if i < 3 else 'x' * i}", i) for i in range(10)] + [("e", None, "một\nmột", 1), ("n", "s", None, 1)]
    df = spark.createDataFrame(docs + docs[:2], "id string, source string, body string, line int")
    got = {(r.id, r.line_no) for r in sitelines.repeated_lines(df, ["body"]).collect()}
    want = {(f"d{i}", 0) for i in range(10)} | {(f"d{i}", 1) for i in range(10)} | {(f"d{i}", 3) for i in range(3)}
    assert got == want
    clean = {r.id: r.body for r in sitelines.without_lines(df, sitelines.repeated_lines(df, ["body"]), ["body"]).collect()}
    assert clean["d0"] == "" and clean["d5"] == "\nxxxxx" and clean["e"] == "một\nmột" and clean["n"] is None
    assert sitelines.repeated_lines(df.limit(0), ["body"]).count() == 0


# Problems 4 and 5


def near_copies(rng, n, edits):
    texts = [sentence(rng, 60) for _ in range(n)]
    for k in range(0, n, 3):
        ws = texts[k].split()
        for _ in range(rng.randrange(edits)):
            ws[rng.randrange(len(ws))] = rng.choice(VOWELS) + str(rng.randrange(99))
        texts.append(" ".join(ws))
    return texts


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = near_copies(rng, 120, 8) + ["ngắn", "", None, texts_long := sentence(rng, 30_000), texts_long]
    rows = [(str(i), t, "x", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "id string, text string, sig string, n int")
    members, linked = neardup.near_duplicates(df, run=3, threshold=0.7)
    got = {(r.id_a, r.id_b) for r in neardup.pairs_of_ids(members, linked).collect()}
    sets = {i: runs(words(t)) for i, t, *_ in rows}
    want = {tuple(sorted((a, b))) for a in sets for b in sets if a < b and sets[a] and likeness(sets[a], sets[b]) >= 0.7}
    assert got == want
    groups = {r.id: r.group for r in neardup.grouped(members, linked).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    empty, none = neardup.near_duplicates(df.limit(0), run=3, threshold=0.7)
    assert neardup.pairs_of_ids(empty, none).count() == 0


def test_hot_entries_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 4)
    postings = spark.createDataFrame([(1, i, 5) for i in range(50)] + [(2, 1, 5), (2, 2, 5)], "entry long, rec long, n int")
    keys = setjoin.partition_keys(37)
    rows = spark.createDataFrame([(int(k), n) for n, k in enumerate(keys)], "k int, n int").repartition(37, "k").selectExpr("n", "spark_partition_id() AS p").collect()
    assert all(r.n == r.p for r in rows)
    spread = setjoin.blocks(postings)
    met = spread.alias("a").join(spread.alias("b"), ["entry", "bi", "bj"]).where("a.rec < b.rec AND (bi = bj OR a.b <> b.b)")
    seen = Counter((r[0], r[1]) for r in met.selectExpr("a.rec", "b.rec").collect())
    assert len(seen) == 50 * 49 // 2 and seen[(1, 2)] == 2 and sum(seen.values()) == 50 * 49 // 2 + 1


def test_classes_of_many_members_are_expanded_by_cells(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 4)
    members = [(1, f"a{i}") for i in range(30)] + [(2, f"b{i}") for i in range(11)] + [(3, "c")]
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 3, 1.0), (1, 9, 0.7)], "a int, b int, likeness double")
    left, right = spark.createDataFrame(members, "a int, x string"), spark.createDataFrame(members, "b int, y string")
    got = Counter(map(tuple, setjoin.expanded(pairs, left, right).collect()))
    assert set(got.values()) == {1}
    assert set(got) == {(x, y, n) for a, b, n in ((1, 2, 0.9), (2, 3, 0.8), (3, 3, 1.0)) for c, x in members if c == a for d, y in members if d == b}


def test_entries_of_many_records_leave_their_bucket(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(8)
    rows = [(i, i % 2, int(k)) for i in range(300) for k in {*rng.integers(0, 2000, 3).tolist(), 5 if i < 120 else 9}]
    df = spark.createDataFrame(rows, "rec long, side int, entry long")
    of = lambda batch: [tuple(batch.column(k).to_numpy() for k in (0, 2, 1))]
    by = defaultdict(set)
    for rec, side, entry in rows:
        by[entry].add((rec, side))
    same = {(a, b) for members in by.values() for a, _ in members for b, _ in members if a < b}
    cross = {(a, b) for members in by.values() for a, s in members for b, t in members if (s, t) == (0, 1)}
    assert setjoin.unpack_ids(setjoin.pack_ids(np.array([5, 4, 1 << 40]))).tolist() == [5, 4, 1 << 40]
    for block, held in ((256, 1 << 23), (8, 64)):  # no entry is too large, and two are, seen over several rounds
        monkeypatch.setattr(setjoin, "BLOCK", block)
        bucket, hot = setjoin.Bucket(False), []
        for rec, _, entry in rows:
            bucket.add(0, 0, setjoin.pack_ids(np.array([rec])), int(entry).to_bytes(5, "little"))
            if bucket.held > held:
                hot += zip(*(c.tolist() for c in bucket.settle()))
        hot += zip(*(c.tolist() for c in bucket.settle()))
        spread = pd.DataFrame(hot, columns=["entry", "rec", "side"])
        cold = {(int(a), int(b)) for x, y in bucket.pairs() for a, b in zip(x, y)}
        assert cold | {(a, b) for _, g in spread.groupby("entry") for a in g.rec for b in g.rec if a < b} == same
        assert set(spread.entry) == (set() if block == 256 else {5, 9})
    for sides, want in ((False, same), (True, cross)):
        assert {tuple(r) for r in setjoin.candidates(df, of, 300, sides).collect()} == want
    hot = df.where("entry IN (5, 9)")
    assert {tuple(r) for r in setjoin.hot_pairs(hot, True).collect()} == {(a, b) for k in (5, 9) for a, s in by[k] for b, t in by[k] if (s, t) == (0, 1)}


def test_signatures_follow_likeness():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8):
        n = 150
        common = int(round(2 * share / (1 + share) * n))
        base = [rng.integers(1, 1 << 47, 2 * n - common) for _ in range(200)]
        flat = lambda parts: (np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts))
        a, b = (setjoin.signatures(*flat([np.sort(p) for p in part])) for part in ([x[:n] for x in base], [np.concatenate([x[:common], x[n:]]) for x in base]))
        assert abs((a == b).mean() - share) < 0.02


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 6, rng.integers(1, 40)) for _ in range(12)]
    index = overlap.FmIndex.of(texts)
    read = overlap.FmIndex.from_bytes(index.to_bytes())
    assert (read.suffixes == index.suffixes).all() and (read.ranks == index.ranks).all() and (read.symbols == index.symbols).all()
    index = read
    asked = np.array([[1, 2, 3], [2, 2, 2], [5, 1, 1], [9, 1, 2]])
    run, seq, place = index.places(*index.search(asked))
    got = set(zip(run.tolist(), seq.tolist(), place.tolist()))
    want = {(q, s, i) for q, row in enumerate(asked) for s, t in enumerate(texts) for i in range(len(t) - 2) if (t[i : i + 3] == row).all()}
    assert got == want
    met = overlap.shared_runs(overlap.FmIndex.of([np.array([1, 2, 3, 4, 5])]), [np.array([9, 1, 2, 3, 4, 9, 1, 2, 3])])
    assert met[["t", "e", "common", "longest"]].values.tolist() == [[0, 0, 2, 4]]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        q, a = sentence(rng, 30), sentence(rng, 40)
        rows.append((f"t{i}", 0, q, a if i % 5 else None))
        if i % 2:
            ws = (q + " | " + a).split()
            for _ in range(rng.randrange(6)):
                ws[rng.randrange(len(ws))] = "khác"
            q2, _, a2 = " ".join(ws).partition(" | ")
            rows.append((f"e{i}", 1, q2, (a2, None, "...")[i % 3]))
    rows += [("x", 0, None, None), ("y", 1, "", ""), ("z", None, "a b c d", "e"), ("e_long", 1, sentence(rng, 20_000), None)]
    df = spark.createDataFrame(rows + rows[:3], "id string, side int, question string, answer string")
    got = {(r.train_id, r.eval_id) for r in overlap.overlaps(df).collect()}
    want = set()
    for i, si, q, a in rows:
        for j, sj, r, b in rows:
            if si == 0 and sj == 1:
                x, y = (words(q) + words(a), words(r) + words(b)) if words(a) and words(b) else (words(q), words(r))
                if runs(x) and likeness(runs(x), runs(y)) >= 0.7:
                    want.add((i, j))
    assert got == want and len(want) > 10
    assert overlap.overlaps(df.limit(0)).count() == 0


# Problem 6


@pytest.mark.parametrize(("unit", "label"), [("Kính gửi {{ten}} ở xã", "slot"), ("Điều %s 1. Hồ sơ", "slot"), ("«ho_ten» nộp đơn", "slot"), ("[TÊN DOANH NGHIỆP] nộp", "slot"), ("503 - Bad Gateway", "message"), ("Server Error Bạn không có quyền xem trang này.", "message"), ("Kính gửi {{" + "tên của cơ quan nhận đơn " * 9 + "}} ở xã", "slot"), ("Nộp tại [điền tên của " + "cơ quan " * 9 + "]", "slot"), ("Vui lòng bật JavaScript để xem nội dung này.", None), ("test test test test test", "filler"), ("Nội dung đang được cập nhật...", "filler"), ("jhkslsfj oqoepiuoo", "filler"), ("Morbin dorem quisora lapsum vetra.", "filler"), ("Họ và tên: ......... Ngày sinh: ../../....", None), ("Tập giá trị hợp lệ là {x | x > 0}.", None), ("Xem chú thích [1] và [2].", None), ("Nội dung đang được cập nhật trong sổ phải có chữ ký.", None), ("Tỷ lệ 5% số tiền được giữ lại.", None), ("Máy chủ lưu trữ quá tải không phải là lý do từ chối hồ sơ.", None)])
def test_seed_labels(unit, label):
    assert residue.seed_label(unit) == label


def test_residue_spreads_to_near_copies_only(spark):
    base = "Trang thông báo rằng hệ thống lưu trữ văn bản của cổng đang được nâng cấp nên quý vị hãy quay lại vào sáng mai để tra cứu tiếp các nội dung cần thiết cho công việc"
    rows = [("t", "a", "TODO: " + base + "."), ("t", "b", "TODO " + base + "."), ("t", "c", base + "."), ("t", "d", sentence(random.Random(1), 30)), ("t", "e", None), ("t", "f", ""), ("u", "a", "Đơn nộp tại {ten_co_quan}."), ("t", "g", "Bình thường. " * 3000)]
    df = spark.createDataFrame(rows + rows[:1], "table_name string, record_id string, text string")
    assert {tuple(r) for r in residue.residue_records(df).collect()} >= {("t", "a"), ("t", "b"), ("u", "a")}
    assert not {("t", "d"), ("t", "e"), ("t", "f"), ("t", "g")} & {tuple(r) for r in residue.residue_records(df).collect()}
    assert residue.residue_records(df.limit(0)).count() == 0


def test_labels_come_through_links(spark):
    same, near, far = "Đang kiểm tra trình duyệt của bạn trước khi truy cập.", "Đang kiểm tra trình duyệt của anh trước khi truy cập.", "Đang kiểm tra trình duyệt của anh trước lúc truy cập."
    rows = [("t", "same", same), ("t", "near", "Lời dẫn. " + near), ("t", "far", far), ("t", "other", "Cơ quan đang kiểm tra hồ sơ của bạn trước khi cấp phép."), ("t", "short", "Quay về trang chủ"), ("t", "none", None)]
    df = spark.createDataFrame(rows, "table_name string, record_id string, text string")
    assert not any(residue.seed_label(u) for _, _, t in rows if t for u in residue.units_of(t))
    assert {r.record_id for r in residue.residue_records(df).collect()} == {"same", "near", "far", "short"}
    units, labels = residue.residue_units(df, spread=False)
    assert {r.record_id for r in units.join(labels, "unit").collect()} == {"same", "short"}


def test_residue_finds_every_reworded_copy(spark, monkeypatch):
    seeds = ["Bài viết đang trong quá trình biên soạn, mời quý vị quay lại sau vài hôm.", "Không thể tải trang vì đường truyền giữa hai trạm trung chuyển của mạng lưới tỉnh đang bị nghẽn."]
    rng = random.Random(9)
    rows = []
    for k, seed in enumerate(seeds):
        ws = seed.split(" ")
        copies = [["Hm", *ws[1:]]]  # no form of the grammar, and each next copy is alike to the one before
        for n in range(1, len(ws)):
            copies.append([*copies[-1][:n], "chữ" + "h" * n, *copies[-1][n + 1 :]])
        copies += [["Hm", *ws[1:n], "lạ" + "g" * n, *ws[n + 1 :]] for n in range(1, len(ws))]
        rows += [(f"{k}:{i}", " ".join(c)) for i, c in enumerate([ws, *copies])]
        rows += [(f"{k}:mix{i}", " ".join(rng.sample(ws[1:], len(ws) // 2) + sentence(rng, 8).split())) for i in range(30)]
    rows += [(f"o{i}", sentence(rng, rng.randrange(4, 20))) for i in range(100)]
    sets = {k: set(t.lower().split(" ")) for k, t in rows}
    monkeypatch.setattr(residue, "EXEMPLARS", (*residue.EXEMPLARS, seeds[1]))
    want = {k for k, t in rows if residue.seed_label(t) or t in residue.EXEMPLARS}
    assert want == {"0:0", "1:0"}
    front = want
    while front:
        front = {k for k in sets.keys() - want if any(likeness(sets[k], sets[s]) >= 0.8 for s in front)}
        want = want | front
    df = spark.createDataFrame([("t", *r) for r in rows], "table_name string, record_id string, text string")
    got = {r.record_id for r in residue.residue_records(df).collect()}
    assert got == want and len(want) > 40


def test_near_duplicates_leave_out_residue_found_through_answers(spark, tmp_path):
    near, far = "Đang kiểm tra trình duyệt của anh trước khi truy cập.", "Đang kiểm tra trình duyệt của anh trước lúc truy cập."
    rng = random.Random(2)
    body = [sentence(rng, 60) for _ in range(3)]
    legal = [("a", body[0], "x"), ("b", body[0] + " thêm", "y"), ("c", f"{far}\n{body[1]}", "x"), ("d", f"{far}\n{body[1]} thêm", "y"), ("e", None, f"{far}\n{body[2]}"), ("f", None, f"{far}\n{body[2]} thêm"), ("w1", body[0], "x")]
    spark.createDataFrame([*legal, legal[0]], "id string, passage string, retrieval_text string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/legal_documents.parquet")
    spark.createDataFrame([("w1", near), ("w2", "Câu trả lời.")], "query_id string, answer string").write.parquet(f"{tmp_path}/task2_warmup.parquet")
    marked = {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert marked == {("legal_documents", "c"), ("legal_documents", "d"), ("task2_warmup", "w1")}  # far is alike to near only
    assert {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()} == {("a", "b"), ("a", "w1"), ("b", "w1"), ("e", "f")}


# Problem 7


def test_related_groups_against_union_find(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(f"r{i:03d}", [f"k{rng.randrange(150)}"] if rng.random() < 0.8 else None, [f"{rng.randrange(120)}"]) for i in range(200)]
    rows += [(f"h{i}", ["hot"], None) for i in range(100)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows + rows[:4], "record_id string, k array<string>, d array<string>")
    got = {r.record_id: r.group_id for r in splits.related_groups(df, {"k": F.col("k"), "d": F.col("d")}).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for r, k, d in rows:
        for kind, values in (("k", k), ("d", d)):
            for v in values or ():
                by[kind, v].append(r)
    for members in by.values():
        for m in members[1:]:
            a, b = sorted((find(members[0]), find(m)))
            root[b] = a
    sizes = Counter(find(r[0]) for r in rows)
    assert got == {r[0]: find(r[0]) for r in rows if sizes[find(r[0])] > 1}
    assigned = splits.assign(df, splits.related_groups(df, {"k": F.col("k"), "d": F.col("d")}), [("train", 0.8), ("test", 0.2)]).collect()
    assert len(assigned) == len(rows) and len({(r.group_id, r.split) for r in assigned}) == len({r.group_id for r in assigned})
    assert splits.related_groups(df.limit(0), {"k": F.col("k")}).count() == 0
    folder = str(tmp_path / "forest")
    splits.related_groups(df, {"k": F.col("k"), "d": F.col("d")}, forest_path=folder)
    forest = [tuple(r) for r in spark.read.parquet(folder).collect()]
    assert len(forest) == sum(n - 1 for n in sizes.values() if n > 1) and all(find(a) == find(b) for a, b in forest)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)  # hubs apart from the rest
    monkeypatch.setattr(skew, "HOT", 20)
    again = splits.related_groups(df, {"k": F.col("k"), "d": F.col("d")})
    assert {r.record_id: r.group_id for r in again.collect()} == got


def test_split_shares_are_close_to_target(spark):
    rng = random.Random(7)
    groups = [(f"g{i}", rng.choice([1, 1, 1, 2, 3, 5, 8])) for i in range(3000)]
    dealt = splits.deal(spark.createDataFrame(groups, "group_id string, size long"), [("train", 0.8), ("validation", 0.15), ("test", 0.05)]).collect()
    total = sum(n for _, n in groups)
    for name, share in (("train", 0.8), ("validation", 0.15), ("test", 0.05)):
        assert abs(sum(r.size for r in dealt if r.split == name) / total - share) < 0.005


# Problem 8


def test_leaked_passages(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 40)) for i in range(12)] + [(90, "ngắn quá"), (91, None), (92, "")]
    docs, want = [], set()
    for i in range(60):
        item = items[i % 12]
        ws = item[1].split()
        start, n = rng.randrange(20), rng.choice([8, 14, 15, 16, 20])
        part = ws[start : start + n]
        docs.append((i, f"{sentence(rng, 20)} ZZ1, {', '.join(part).upper()} - zz2 {sentence(rng, 9)}", "t"))
        if len(part) >= 15:
            want.add((i, item[0]))
    docs += [(100, None, "t"), (101, "", "t"), (102, items[0][1] + " xyz " + items[1][1], "t")]
    want |= {(102, 0), (102, 1)}
    df, asked = spark.createDataFrame(docs, "doc_id long, text string, start string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (10_000_000, 300):  # one block of items, and several
        found = leakage.leaked_passages(df, asked, block_chars=size).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
    texts = dict((d[0], d[1]) for d in docs)
    assert all(len(words(texts[r.doc_id][r.start : r.end])) == r.words for r in found)
    assert leakage.leaked_passages(df, asked.limit(0)).count() == 0 and leakage.leaked_passages(df.limit(0), asked).count() == 0


# Problem 9


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    docs = [(i, ("a", "b", "c")[min(i % 10, 2)] if i % 17 else None, sentence(rng, rng.randrange(20, 60))) for i in range(1500)] + [(9999, "a", None), (9998, "a", "")]
    targets = [("a", 0.3, 2), ("b", 0.2, 1), ("c", 0.5, 1)]
    df, wanted = spark.createDataFrame(docs, "key long, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(df, wanted)
    for r in shares.collect():
        assert abs(r.share - r.target_share) < 0.02 and r.repeats <= r.max_repeats
    assert drawn.where("copies < 1").count() == 0
    assert mixing.mix(df, wanted.limit(0))[0].count() == 0
    none, empty = mixing.mix(df.limit(0), wanted)
    assert none.count() == 0 and {r.tokens for r in empty.collect()} == {0}


def test_mix_follows_posteriors(spark):
    rng = random.Random(12)
    own = {"a": "alpha anh arras aster atlas".split(), "b": "beta bison bolero bruma bastion".split()}
    text = lambda d: " ".join(rng.choice(own[d] + VOWELS[:10]) for _ in range(40))
    docs = [(i, s, text(d)) for i in range(1600) for s, d in [(("a", "a"), ("a", "b"), ("b", "b"), (None, "a"), ("x", "b"))[(0, 0, 1, 2, 2, 2, 3, 4)[i % 8]]]]
    df = spark.createDataFrame(docs, "key long, source string, text string")
    wanted = spark.createDataFrame([("a", 0.65, 2), ("b", 0.35, 1)], "source string, target_share double, max_repeats int")
    model, quality = mixing.train_classifier(df, ["a", "b"])
    assert quality["accuracy"] > 0.6 and abs(quality["accuracy"] - quality["confidence"]) < 0.1
    drawn, shares = mixing.mix(df, wanted)
    assert all(abs(r.share - r.target_share) < 0.02 for r in shares.collect())
    rows, looks = drawn.collect(), {k: ("a" if sum(w in own["a"] for w in t.split()) > 5 else "b") for k, _, t in docs}
    source = {k: s for k, s, _ in docs}
    mean = lambda s, d: np.mean([r.rate for r in rows if source[r.key] == s and looks[r.key] == d] or [0.0])
    assert mean("a", "a") > mean("a", "b") + 0.1  # domain a is short of tokens, so its texts get the higher rates
    assert {r.source for r in rows if source[r.key] is None} == {"a"} and {r.source for r in rows if source[r.key] == "x"} == {"b"}
    assert all(r.copies <= 2 for r in rows)


# Problem 10


def test_reading_levels(spark):
    rng = random.Random(3)
    easy = lambda: ". ".join(sentence(rng, 5) for _ in range(10)) + "."
    hard = lambda: ". ".join("căn cứ " + ", ".join(sentence(rng, 12) + f" x{rng.randrange(500)}" for _ in range(4)) for _ in range(3)) + "."
    docs = [(i, easy() if i % 2 else hard()) for i in range(200)] + [(900, None), (901, ""), (902, hard() * 300)]
    labels = [(i, f"r{k}", 1 if i % 2 else 4) for i in range(120) for k in range(2)]
    df, rated = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rater string, band int")
    got = {r.doc_id: r.band for r in reading.reading_levels(df, rated).collect()}
    assert all(got[i] == (1 if i % 2 else 4) for i in range(120, 200)) and got[900] == got[901] == 1 and got[902] == 4
    assert {r.band for r in reading.reading_levels(df, rated.limit(0)).collect()} == {1}
    assert reading.reading_levels(df.limit(0), rated).count() == 0


def test_words_of_matches_plain_split():
    texts = ["Xin chào  các bạn, số 12/2001.", None, "", "a_b ĐỒNG…", "Ｋíｎｈ x"]
    offsets, flat = words_of(pa.array(texts))
    assert [flat.to_pylist()[a:b] for a, b in zip(offsets[:-1], offsets[1:])] == [words(t) for t in texts]
