"""Arabic lists over pages, table rows and windows."""

import random
import re

from quarry.operators import listings as L

SCHEMA = "doc_id long, page_seq int, page string, text string"


def read(spark, *texts, **kw):
    df = spark.createDataFrame([(1, k, f"p{k}", t) for k, t in enumerate(texts, 1)], SCHEMA)
    return {r["field"]: [(i["text"], i["page"]) for i in r["items"]] for r in L.listings(df, **kw).collect()}


def test_lists_over_pages(spark):
    got = read(
        spark, "مقدمة", "I. الوثائق الإدارية وتتكون من:\n1. كراس الشروط الممضى\nقصير\n2. السجل التجاري للشركة", None, "الفصل 3 : لا يعد\n3) بطاقة الإرشادات العامة\nكراس الشروط الممضى",
        "II. الوثائق الخاصة بالعرض الفني:\n- جذاذات فنية للمعدات", "تابع للقائمة الفنية",
    )
    assert got["administrative_documents"] == [("كراس الشروط الممضى", "p2"), ("السجل التجاري للشركة", "p2"), ("بطاقة الإرشادات العامة", "p4")]
    # without a closing mark a list goes to the end
    assert got["technical_documents"] == [("جذاذات فنية للمعدات", "p5"), ("تابع للقائمة الفنية", "p6")]


def test_tables_bullets_dashes(spark):
    rows = "الوثائق المكونة للعرض\n| عدد | الوثيقة | الختم |\n|---|---|---|\n| 1 | جدول الأثمان الممضى | نعم |\n| نعم | 2 | وثيقة التعهد |\n| 3 | السجل التجاري | لا |"
    got = read(spark, rows)
    assert got == {"financial_documents": [("جدول الأثمان الممضى", "p1"), ("وثيقة التعهد", "p1")]}  # one administrative row is too few
    got = read(spark, "يتكون العرض المالي من الوثائق التالية:\n• جدول الأثمان الأول\nأ - وثيقة التعهد المالي\nترسل الظروف مغلقة\nلا يعد هذا السطر")
    assert got == {"financial_documents": [("جدول الأثمان الأول", "p1"), ("وثيقة التعهد المالي", "p1")]}
    got = read(spark, "الوثائق التي ترسل مباشرة للإدارة: - السجل التجاري للمؤسسات - الضمان الوقتي ملاحظة هامة - كل الوثائق المذكورة - لا يعد أيضا")
    assert got == {"administrative_documents": [("السجل التجاري للمؤسسات", "p1"), ("الضمان الوقتي", "p1")]}
    assert read(spark, "texte sans arabe", "", None) == {}


def test_spans_equal_brute_force(spark):
    rng = random.Random(5)
    rule = L.Listing("f", r"OPENب", r"CLOSEب", most=7)
    docs = {d: ["\n".join(rng.choice(["OPENب", "CLOSEب", "item number %d ب" % rng.randrange(5), "x", "الفصل item"]) for _ in range(rng.randrange(5))) + "ب" for _ in range(rng.randrange(6))] for d in range(60)}
    df = spark.createDataFrame([(d, k, str(k), t) for d, texts in docs.items() for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: [(i["text"], i["page"]) for i in r["items"]] for r in L.listings(df, [rule]).collect()}
    expected = {}
    for d, texts in docs.items():
        items, on = [], False
        for k, t in enumerate(texts):
            if not on:
                if "OPENب" not in t:
                    continue
                on, t = True, t.split("OPENب", 1)[1]
            parts = t.split("CLOSEب", 1)
            items += [(x.strip(), str(k)) for x in parts[0].split("\n") if len(x.strip()) >= 8 and "الفصل" not in x]
            if len(parts) > 1:
                break
        items = items[:7]
        if items:
            expected[d] = [x for n, x in enumerate(items) if x[0] not in [y[0] for y in items[:n]]]
    assert got == expected and len(got) > 5


def test_windows(spark):
    def facts(*texts, rules=None):
        df = spark.createDataFrame([(1, k, f"p{k}", t) for k, t in enumerate(texts, 1)], SCHEMA)
        return {r["field"]: (r["text"], r["page"]) for r in L.arabic_facts(df, rules).collect()}

    got = facts("كلام", "آخر أجل لقبول العروض يوم 12 مارس 2024 على الساعة العاشرة", "الفصل 6: صلاحية العروض مدة 90 يوما\nالفصل 7: الضمان الوقتي قدره 500 دينار الفصل 8: فتح الظروف في جلسة علنية")
    assert got["deadline"][1] == "p2" and "12 مارس 2024" in got["deadline"][0]
    assert got["validity"] == ("الفصل 6: صلاحية العروض مدة 90 يوما", "p3")
    assert got["caution"] == ("الفصل 7: الضمان الوقتي قدره 500 دينار", "p3")
    assert got["opening"] == ("الفصل 8: فتح الظروف في جلسة علنية", "p3")
    window = [L.Around("w", ("ثانية", "أولى"), before=3, after=9, most=100)]
    for text in ["ابت أولى ثم ثانية وبعد", "أولى", "لا شيء", ""]:
        flat = re.sub(r"\s+", " ", text).strip()
        at = next((flat.find(m) for m in window[0].marks if m in flat), -1)
        wanted = {} if at < 0 else {"w": (flat[max(0, at - 3) : at + 9].strip(" .;:-"), "p1")}
        assert facts(text, rules=window) == wanted
    assert facts("الضمان النهائي 903 من القيمة")["definitive_caution"][0] == "الضمان النهائي 3 96 من القيمة"
    assert facts(None, "abc") == {}
