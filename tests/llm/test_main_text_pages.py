"""Pages in other languages and pages whose markup never ends."""

import time

import pytest

from articlelake.llm.main_text import main_text

PROSE = {
    "ru": [
        "Вчера городской совет одобрил новый план развития общественного транспорта, который жители обсуждали больше года.",
        "По словам инженеров, первые трамваи выйдут на линию весной. До этого рабочие заменят рельсы, стрелки и провода на всех "
        "улицах центра. Магазины останутся открытыми, а автобусы временно пойдут в объезд по соседним улицам и набережной.",
    ],
    "zh": [
        "市议会昨天批准了新的公共交通发展计划，居民们对此已经讨论了一年多，许多人希望工程能够尽快开始。",
        "工程师表示，第一批有轨电车将于明年春天投入运营。在此之前，工人们会更换市中心所有街道的轨道、道岔和电线。商店将继续营业，"
        "公共汽车则暂时绕行附近的街道和河边道路，乘客可以在车站看到新的时刻表。",
    ],
    "ar": [
        "وافق مجلس المدينة أمس على خطة جديدة لتطوير النقل العام، وهي خطة ناقشها السكان منذ أكثر من عام كامل.",
        "وقال المهندسون إن أولى عربات الترام ستعمل في الربيع المقبل. وقبل ذلك سيستبدل العمال القضبان والأسلاك في جميع شوارع "
        "وسط المدينة. وستبقى المتاجر مفتوحة، بينما تسير الحافلات مؤقتا في الشوارع المجاورة وعلى طريق النهر.",
    ],
}


@pytest.mark.parametrize("declared", [True, False])
@pytest.mark.parametrize("language", sorted(PROSE))
def test_languages_without_stop_words_keep_their_article(language, declared):
    name = "article" if declared else "div"
    menu = "".join(f"<li><a href='/{k}'>{PROSE[language][0][:9]}</a></li>" for k in range(9))
    plain_menu = " ".join(word[:8].strip("，、。.,") for word in PROSE[language][1].split()[:9])
    page = (
        f"<html><head><title>x</title></head><body><nav><ul>{menu}</ul></nav><ul>{menu}</ul>"
        f"<{name}>{''.join(f'<p>{p}</p>' for p in PROSE[language])}</{name}>"
        f"<ul>{menu}</ul><footer>{plain_menu}</footer></body></html>"
    )
    assert main_text(page) == "\n".join(PROSE[language])


def test_long_lists_of_names_are_no_article_in_an_unlisted_language():
    names = "Москва Казань Самара Тверь Омск Пермь Уфа Томск Курск Орёл Псков Рязань Тула Сочи Чита"
    page = f"<body><div>{''.join(f'<p>{p}</p>' for p in PROSE['ru'])}</div><div><div>{names}</div></div></body>"
    assert main_text(page) == "\n".join(PROSE["ru"])


@pytest.mark.parametrize(
    "unit, tail",
    [
        ("<div ", ""),
        ("<title>", ""),
        ('<a ">" ', ""),
        ("<script ", ""),
        ("<!x", ""),
        ("<svg>", "</noscript>"),
        ("<div>", "</section>"),
        ("<div class=ad>", ""),
        ("<div class=ad id=x>text ", ""),
    ],
)
def test_time_grows_with_the_length_of_a_broken_page(unit, tail):
    def seconds(n):
        page = unit * n + tail * n
        start = time.perf_counter()
        main_text(page)
        return time.perf_counter() - start

    seconds(1000)
    short, long = min(seconds(10_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert long < 8 * short + 0.2  # quadratic: 16 times


def test_a_long_attribute_and_a_long_run_of_marks_are_read_once():
    start = time.perf_counter()
    assert main_text("<div " + "a" * 500_000 + "><p>" + "the of and to " * 30 + "!" * 300_000 + "a") != ""
    assert time.perf_counter() - start < 5


def test_tags_whose_quotes_never_close_end_at_the_next_mark():
    page = "<article><p class=\"a>" + "the ship is in the harbour and it is not on the sea. " * 4 + "</p></article>"
    assert main_text(page).startswith("the ship")
