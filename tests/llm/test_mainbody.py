import numpy as np

from veyra.llm.mainbody import line_events, main_body, main_lines, threshold

PAGE = """Този сайт използва бисквитки, за да измерваме посещенията. Като продължите, вие се съгласявате с условията.
Приемам всички
# Градски портал за родители
![Лого](https://x.example/l.png)
* [Новини](/n)
* [За нас](/z)
Начало / news / Градец
Вижте още
Ден на шахмат в Градец (1.02.2026)
Тази година поканихме гости от Градец, които показаха плуване пред всички гру…
# Съобщение № 3 на Детска градина „Тиха гора“ до родителите
Публикувано от екипа на Детска градина „Тиха гора“
Храната се приготвя на място, а менюто за седмицата се окачва пред столовата всеки сряда.
---
* За второ дете от същото семейство отстъпката е 15 процента от таксата.
Сподели с приятели
| рисуване | 20,50 € |
[Документ 1](/files/a.pdf)
**Новини от Градец: шахмат
Телефон на Детска градина „Тиха гора“, Градец: 02 111 2233
Споделете с нас любимата си рецепта за бисквитки до петък, защото групата в Градец ще готви.
Прочетено 312 пъти, Градец
Цените могат да бъдат променени без предизвестие; валидни са само обявените в канцеларията.
02 111 2233 | office@x.example
Нагоре ↑
© 2026 x.example. Всички права запазени."""


def test_page():
    assert main_lines(PAGE) == [11, 13, 15, 17, 18, 19, 20, 21]


FOREIGN = """Startseite
Über uns
Kindergarten Sonnenhügel
Unsere Gruppen im neuen Jahr
Die Gruppe der Bären bekommt im Herbst einen neuen Raum mit Blick auf den Garten, in dem auch gemalt und gebastelt wird.
Anmeldungen sind bis Ende März im Büro möglich, und wer ein Geschwisterkind hat, bringt bitte die Bescheinigung mit.
- feste Schuhe
Das Mittagessen wird in der eigenen Küche gekocht und kostet im Monat so viel wie im letzten Jahr auch schon.
Wald
Spielplatz
Termine
Fotos
Impressum"""


def test_the_smoothed_ratio_decides_where_no_word_is_known():
    assert main_lines(FOREIGN) == [4, 5, 6, 7, 8]  # the heading right above goes with its text
    assert len(main_lines(FOREIGN, cut=-1.0)) == 13 and main_lines(FOREIGN, cut=3.0) == []  # the threshold switched off, and above all
    assert main_lines(PAGE, cut=-1.0) != main_lines(PAGE) != main_lines(PAGE, cut=3.0)


def test_a_page_of_text_alone_is_kept_whole():
    assert main_lines("\n".join(FOREIGN.split("\n")[4:6])) == [1, 2]


def test_nothing_to_keep():
    assert main_lines("") == [] and main_lines("---\n\n* * *") == []
    assert main_lines("Меню\nНачало\nСподели с приятели") == []
    assert threshold(np.array([1.0, 1.0]), 0.4) == 1.0


def test_marks():
    assert line_events("* Автор: екипът").cue == "insert" and line_events("Вижте още").cue == "side" and line_events("Цените за… (1.02.2026)").cue == "listing"
    assert line_events("[Документ 1](/files/a.pdf)").data and line_events("| рисуване | 20,50 € |").data and line_events("## Прием").head


def test_table(spark):
    cols = "page_id long, raw_markdown string, line_no int, text string"
    df = spark.createDataFrame([(1, PAGE, 9, "q"), (1, PAGE, 9, "q"), (2, None, 1, None), (None, PAGE, 1, None), (3, "", 1, ""), (4, "дълъг ред с много думи, " * 20_000 + "край.", 1, "")], cols)
    got = [(r.page_id, r.line_no) for r in main_body(df).collect()]
    assert len(got) == len(set(got)) == len(main_lines(PAGE)) + 1 and (4, 1) in got
    assert main_body(spark.createDataFrame([], cols)).count() == 0
