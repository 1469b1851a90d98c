import random
import re

from pyspark.sql import functions as F

from noticeflow.functions import contact


def test_clean_phones(values):
    got = values(contact.clean_phones, [["138 0000 0000", "138-0000", "123456", "-------", "1" * 16,
                                         "电话：010-12345678", "13800000000", None]], "array<string>")
    assert got == [["13800000000", "138-0000", "010-12345678"]]


def test_clean_emails_and_names(values):
    assert values(contact.clean_emails, [[" A@B.cn ", "a@b.cn", "a@b", "@.x", None, "x" * 98 + "@.y"]],
                  "array<string>") == [["a@b.cn"]]
    assert values(contact.clean_contact_names, [["　李 ", "李雷", " 李雷", "x" * 21]],
                  "array<string>") == [["李雷"]]
    assert values(contact.clean_company, [" 甲、乙，丙,;；公司 ", None]) == ["甲乙丙公司", ""]


def test_extract_phones_in_shape_order(values):
    text = "传真 010-87654321 手机13800000000 电话：\n 0571-1234567 订单4151891120517744"
    loose = values(contact.extract_phones, [text])[0]
    assert loose[:2] == ["13800000000", "0571-1234567"] or "0571-1234567" in loose
    assert "15189112051" in loose                 # no digit boundary
    strict = values(lambda c: contact.extract_phones(c, strict=True), [text])[0]
    assert "15189112051" not in strict and "13800000000" in strict


def test_extract_emails(values):
    assert values(contact.extract_emails, ["x A.b@C.com, a.b@c.com -q@d.org .z@e.net", None]) == [
        ["a.b@c.com"], []]


def test_extract_company_and_names(values):
    assert values(contact.extract_company, [
        "采购人：某处\n供应商：甲有限公司、乙", "中标人:丙集团", "采购人：" + "长" * 31 + "公司", ""]) == [
        "甲有限公司", "丙集团", "", ""]
    assert values(contact.extract_contact_names, ["联系人：李雷 项目联系：HanMei\n联系人：详见公告、联系人:李雷"]) == [
        ["李雷", "HanMei"]]


def test_split_contact(values):
    got = values(contact.split_contact, ["李雷，13800000000 a@b.cn", "010-1234567", "张：三", "0123-12345678"])
    assert [tuple(g.values()) for g in got] == [
        ("李雷", "13800000000", "a@b.cn"), ("", "010-1234567", ""), ("张三", "", ""),
        ("", "0123-12345678", "")]


def test_simple_phones_puts_mobiles_first(values):
    assert values(contact.format_phones, ["010-1234567、13800000000", "见附件", None]) == [
        "13800000000, 010-1234567", "见附件", ""]


def _expand(text):
    """The rule, number by number."""
    spots = sorted([(m.start(), m.end(), m.group()) for p in (r"0\d{2,3}-?\d{7,8}", r"1[3-9]\d{9}")
                    for m in re.finditer(p, text)])
    out = []
    for i, (_, end, full) in enumerate(spots):
        out.append(full)
        stop = spots[i + 1][0] if i + 1 < len(spots) else len(text)
        for t in re.findall(r"[\\/、，,;\s]+(\d{4,8})\b", text[end:stop]):
            head, dash, local = full.rpartition("-")
            if dash and len(t) <= len(local) or not dash and len(t) < len(full):
                out.append(full[:-len(t)] + t)
    return list(dict.fromkeys(out))


def test_expand_phones_examples(values):
    assert values(contact.expand_phones, ["010-11112222/3344", "010-11112222、5555，66667777", "3344", None]) == [
        ["010-11112222", "010-11113344"], ["010-11112222", "010-11115555", "010-66667777"], [], []]


def test_expand_phones_equals_rule_on_random_text(values):
    rng = random.Random(7)
    pieces = ["010-11112222", "13812345678", "0571-7654321", "02112345678", "/", "、", " ", "\\", "4455",
              "123456", "张", "转", "88", "01381234567890", "　", "-", "99999999"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    assert values(contact.expand_phones, texts) == [_expand(t) for t in texts]


def test_names_of_line(values):
    assert values(contact.names_of_line, ["王五、赵六 010-62223333/4444", "李 雷雷,Al;x"]) == [
        ["王五", "赵六"], ["雷雷", "Al"]]


def _match(a, b):
    da, db = (["".join(c for c in p if c.isdigit()) for p in side] for side in (a, b))
    return any(x and y and (x == y or len(x) >= 8 and len(y) >= 8 and x[-8:] == y[-8:])
               for x in da for y in db)


def test_phone_key_equals_pairwise_rule(spark):
    rng = random.Random(3)

    def side():
        return ["".join(rng.choice("1 12-") for _ in range(rng.randint(0, 11)))
                for _ in range(rng.randint(0, 3))]

    rows = [(side(), side()) for _ in range(5000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)],
                               "i int, a array<string>, b array<string>")
    got = df.select("i", contact.phones_match(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [_match(a, b) for a, b in rows]
