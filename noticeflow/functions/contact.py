"""Phone numbers, e-mail addresses, names and companies in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .chars import WS, first_filled, let, split_filled, strip, text_or_empty

# Fixed values. \p{Nd} is every Unicode digit, WS every Unicode space.
D = r"\p{Nd}"
MOBILE = rf"1[3-9]{D}{{9}}"
LANDLINE = rf"0{D}{{2,3}}-?{D}{{7,8}}"
LOCAL_LINE = rf"{D}{{3,4}}-{D}{{7,8}}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LABELLED_PHONE = rf"(?d)(?:电话|手机|联系方式|联系人).*?[:：]?{WS}*([{D}\-]{{7,15}})"
PHONE_SHAPES = (MOBILE, LANDLINE, LOCAL_LINE)
COMPANY_LABELS = ("采购人", "供应商", "中标人", "代理机构")
COMPANY_WORDS = ("公司", "有限公司", "集团", "企业", "单位", "采购人", "代理机构", "供应商", "中标人")
NAME_LABELS = ("联系人", "项目联系")
NAME_STOP_WORDS = (
    "联系人", "联系方式", "项目联系", "电话", "手机", "邮箱", "地址", "附件", "无", "项目",
    "名称", "内容", "详见", "见附件", "null", "nan", "none", "公司", "单位", "代表",
)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(pattern), F.lit(group))


# ---------------------------------------------------------------- cleaning

def digits_only(phone: Column) -> Column:
    return F.regexp_replace(phone, rf"[^{D}]", "")


def clean_phones(phones: Column) -> Column:
    bare = F.transform(phones, lambda p: F.regexp_replace(text_or_empty(p), rf"[^{D}\-]", ""))
    return F.array_distinct(F.filter(
        bare, lambda p: F.length(p).between(7, 15) & p.rlike(rf"[{D}]")))


def clean_emails(emails: Column) -> Column:
    bare = F.transform(emails, lambda e: F.lower(strip(text_or_empty(e))))
    return F.array_distinct(F.filter(
        bare, lambda e: e.contains("@") & e.contains(".") & F.length(e).between(5, 100)))


def clean_company(company: Column) -> Column:
    return F.translate(strip(text_or_empty(company)), "、,，;；", "")


def clean_contact_names(names: Column) -> Column:
    bare = F.transform(names, lambda n: strip(text_or_empty(n)))
    return F.array_distinct(F.filter(bare, lambda n: F.length(n).between(2, 20)))


def split_phone_list(phones: Column) -> Column:
    return split_filled(phones, ",")


# ------------------------------------------------------------- free text

def extract_phones(text: Column, strict: bool = False) -> Column:
    """All phone numbers, shape by shape, first occurrence first.

    ``strict`` refuses numbers that are part of a longer run of digits.
    """
    def bound(p: str) -> str:
        return rf"(?<!{D}){p}(?!{D})" if strict else p

    labelled = LABELLED_PHONE + (rf"(?![{D}\-])" if strict else "")
    found = F.concat(_all(text, labelled, 1), *[_all(text, bound(p)) for p in PHONE_SHAPES])
    bare = F.transform(found, lambda p: F.regexp_replace(p, rf"[^{D}\-]", ""))
    return F.array_distinct(F.filter(bare, lambda p: F.length(p).between(7, 15)))


def extract_emails(text: Column) -> Column:
    ok = F.filter(_all(text, EMAIL), lambda e: (
        F.length(e).between(5, 100) & ~F.left(e, F.lit(1)).isin("@", ".", "-")
        & ~F.right(e, F.lit(1)).isin("@", ".", "-")))
    return F.array_distinct(F.transform(ok, F.lower))


def extract_company(text: Column) -> Column:
    """First label whose first value names a company; '' when none does."""
    def value(label: str) -> Column:
        found = strip(F.regexp_extract(
            text_or_empty(text), rf"{label}[：:]{WS}*([^、\n]{{2,30}})(?:[、\n]|\z)", 1))
        return F.when(found.rlike("|".join(COMPANY_WORDS)), found)

    return F.coalesce(*[value(label) for label in COMPANY_LABELS], F.lit(""))


def extract_contact_names(text: Column) -> Column:
    found = F.concat(*[
        _all(text, rf"{label}[：:]{WS}*([A-Za-z\x{{4e00}}-\x{{9fa5}}]{{2,10}})(?:[、\n]|{WS}|\z)", 1)
        for label in NAME_LABELS])
    stop = "|".join(NAME_STOP_WORDS)
    return F.array_distinct(F.filter(found, lambda n: ~n.rlike(stop)))


def extract_contacts(text: Column) -> Column:
    return F.struct(
        extract_phones(text).alias("phones"),
        extract_emails(text).alias("emails"),
        extract_company(text).alias("company"),
        extract_contact_names(text).alias("contacts"),
    )


# -------------------------------------------------------- one contact cell

def split_contact(text: Column) -> Column:
    """'name phone e-mail' in any order -> struct(name, phone, email)."""
    text = text_or_empty(text)
    phone = first_filled(*[F.regexp_extract(text, p, 0) for p in (MOBILE, LANDLINE, LOCAL_LINE)])
    email = F.regexp_extract(text, EMAIL, 0)
    # replace() with an empty search text leaves its input alone.
    rest = F.replace(F.replace(text, phone, F.lit("")), email, F.lit(""))
    name = strip(F.translate(rest, "、，,：:", ""))
    return F.struct(name.alias("name"), phone.alias("phone"), email.alias("email"))


def simple_phones(text: Column) -> Column:
    """Mobiles first, then landlines, each once."""
    return F.array_distinct(F.concat(_all(text, MOBILE), _all(text, LANDLINE)))


def first_phone(text: Column) -> Column:
    return text_or_empty(F.get(simple_phones(text), F.lit(0)))


def format_phones(text: Column) -> Column:
    """Phones of a text joined by ', '; the text itself when it holds none."""
    found = simple_phones(text)
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(text_or_empty(text))


def _located(text: Column, pattern: str) -> Column:
    """Matches with their offsets: array<struct<start, stop, number>>.

    The pieces between matches come from split(), so the start of match i is
    the length of the first i+1 pieces plus that of the first i matches.
    """
    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(x))

    def place(found: Column) -> Column:
        return F.transform(found["hits"], lambda number, i: let(
            total(F.slice(found["gaps"], F.lit(1), i + 1))
            + total(F.slice(found["hits"], F.lit(1), i)),
            lambda start: F.struct(start.alias("start"), (start + F.length(number)).alias("stop"),
                                   number.alias("number"))))

    return let(F.struct(_all(text, pattern).alias("hits"),
                        F.split(text, pattern, -1).alias("gaps")), place)


def _with_tails(full: Column, tails: Column) -> Column:
    """The full number, then one number per shortened tail."""
    dash = F.instr(full, "-")
    local_len = F.when(dash > 0, F.length(full) - dash).otherwise(F.length(full) - 1)
    usable = F.filter(tails, lambda t: F.length(t) <= local_len)
    swapped = F.transform(usable, lambda t: F.concat(
        F.left(full, F.length(full) - F.length(t)), t))
    return F.concat(F.array(full), swapped)


def expand_phones(text: Column) -> Column:
    """Full numbers plus numbers abbreviated to their last 4-8 digits.

    '010-11112222/3344' gives 010-11112222 and 010-11113344.
    """
    tail = F.lit(rf"(?U)(?:[\\/、，,;]|{WS})+(\d{{4,8}})\b")

    def read(t: Column) -> Column:
        spots = F.array_sort(F.concat(_located(t, LANDLINE), _located(t, MOBILE)))

        def expand(all_spots: Column) -> Column:
            def one(spot: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(all_spots, i + 1)["start"], F.length(t))
                between = F.substr(t, spot["stop"] + 1,
                                   F.greatest(stop - spot["stop"], F.lit(0)))
                return _with_tails(spot["number"], F.regexp_extract_all(between, tail, F.lit(1)))

            return F.array_distinct(F.flatten(F.transform(all_spots, one)))

        return let(spots, expand)

    return let(text_or_empty(text), read)


def names_of_line(text: Column) -> Column:
    """Names left in an agent's contact line once its numbers are taken out."""
    bare = F.regexp_replace(F.regexp_replace(text, LANDLINE, ""), rf"{D}{{7,13}}", "")
    parts = F.split(bare, rf"(?:[、，,;\\]|{WS})")
    letters = F.transform(parts, lambda n: F.regexp_replace(
        n, r"[^\x{4e00}-\x{9fa5}a-zA-Z]", ""))
    return F.filter(letters, lambda n: F.length(n) >= 2)


# ------------------------------------------------------------- attribution

def phone_keys(phones: Column) -> Column:
    """Comparable keys: the last 8 digits, or all of them when there are fewer.

    Two numbers belong to one owner when they are equal or both have at least
    eight digits and agree in the last eight, which is equality of this key.
    """
    keys = F.transform(phones, lambda p: F.right(digits_only(text_or_empty(p)), F.lit(8)))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def phones_match(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(phone_keys(a), phone_keys(b)), F.lit(False))


def project_owner(phones: Column, agent_name: Column, agent_phones: Column,
                  buyer_name: Column, buyer_phones: Column) -> Column:
    """Company that owns the phones, or null when neither side matches."""
    return (F.when((agent_name != "") & phones_match(phones, agent_phones), agent_name)
            .when((buyer_name != "") & phones_match(phones, buyer_phones), buyer_name))


def contact_role(company: Column, agent_name: Column, buyer_name: Column) -> Column:
    return (F.when(company == agent_name, F.lit("agent"))
            .when(company == buyer_name, F.lit("buyer"))
            .otherwise(F.lit("agent")))
