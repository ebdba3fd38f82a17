"""Numbers in their printed forms."""

import re


def test_printed_forms_are_found_and_linked(spark):
    from boxwright.llm.pseudonyms import pseudonymise

    forms = {
        "iban": [["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00"], ["BE68539007547034", "BE68 5390 0754 7034"], ["GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19"]],
        "card": [["378282246310005", "3782 822463 10005", "3782-822463-10005"], ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"], ["30569309025904", "3056 930902 5904"]],
        "phone": [["+442079460958", "+44 20 7946 0958", "+44-20-7946-0958", "+44 (20) 7946.0958"], ["+12125550100", "+1 (212) 555-0100", "+1-212-555-0100"], ["+33 1 42 68 53 00", "+33142685300"]],
    }
    flat = [(kind, i, v) for kind, groups in forms.items() for i, g in enumerate(groups) for v in g]
    texts = [f"see {v} EUR, ok" for _, _, v in flat] + ["4111 1111 1111 1111 123", "4111 1111 1111 1112", "DE89 3704 0044 0532 0130 01", "+1 212", "1234 5678"]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").orderBy("doc_id").collect()
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[A-Z]", "A", s))
    linked = {}
    for (kind, i, v), text, r in zip(flat, texts, rows, strict=False):
        assert (v, r.kinds) == (v, [kind]) and shape(r.text) == shape(text) and v not in r.text
        linked.setdefault((kind, i), set()).add(re.sub("[^0-9A-Z]", "", r.text.removeprefix("see ").removesuffix(" EUR, ok")))
    assert all(len(x) == 1 for x in linked.values()), linked
    assert len(set().union(*linked.values())) == len(linked)
    cvv, *left = rows[len(flat) :]
    assert cvv.kinds == ["card"] and cvv.text.endswith(" 123") and cvv.text.replace(" ", "")[:16] == next(iter(linked["card", 1]))
    assert [r.text for r in left] == texts[len(flat) + 1 :]


def test_social_security_numbers_stay_valid_and_distinct(spark):
    from boxwright.llm.pseudonyms import pseudonymise

    valid = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
    numbers = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 2, 78, 664, 665, 667, 668, 898, 899) for g in (1, 50, 99) for s in (1, 2, 101, 102, 4096, 5000, 9998, 9999)]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(numbers)), "doc_id bigint, text string"), "k").collect()
    assert all(r.kinds == ["ssn"] and valid.fullmatch(r.text) for r in rows)
    assert len({r.text for r in rows}) == len(numbers) and sum(r.text == numbers[r.doc_id] for r in rows) <= 1
    left = pseudonymise(spark.createDataFrame([(1, "000-12-3456 666-12-3456 912-12-3456 123-00-4567 123-45-0000")], "doc_id bigint, text string"), "k").first()
    assert left.kinds == [] and left.text.startswith("000-12-3456")


def test_dates_with_the_month_first(spark):
    from datetime import datetime

    from boxwright.llm.pseudonyms import pseudonymise

    texts = ["12/31/1999", "31/12/1999", "1999-12-31", "13/13/1999"]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").orderBy("doc_id").collect()
    month, day, iso, none = (r.text for r in rows)
    assert none == texts[3] and month != texts[0]
    assert datetime.strptime(month, "%m/%d/%Y") == datetime.strptime(day, "%d/%m/%Y") == datetime.strptime(iso, "%Y-%m-%d")


def test_pseudonyms_of_nothing(spark):
    from boxwright.llm.pseudonyms import pseudonymise

    assert pseudonymise(spark.createDataFrame([], "doc_id bigint, text string, kind string"), "k").count() == 0
