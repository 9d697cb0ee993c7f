import pytest

from veyra.llm.language import LANGUAGES, fit_model, found_languages, judge, known_label, languages, latinized, plain, train

LINES = {
    "bg": ["Храната се приготвя на място, а менюто се окачва всеки понеделник.", "Всеки четвъртък децата имат рисуване в игротеката.", "Документите за записване се подават в канцеларията.", "Цената за нови деца остава старата през лятото.", "Попитах за двора и ми казаха, че ремонтът ще приключи скоро."],
    "en": ["Meals are cooked on site, and the menu hangs outside each Monday.", "Every Thursday the children have drawing in the play corner.", "Papers for enrolment are handed in at the office.", "New children pay more, while the old price stays for others.", "I asked about the yard and was told the works would end soon."],
    "ru": ["Еду готовят на месте, а меню вывешивают каждый понедельник.", "Каждый четверг дети занимаются рисованием в игровой комнате.", "Заявление о приёме нужно принести в канцелярию.", "Новые дети платят больше, остальные по старой цене.", "Мы спросили про двор, и нам ответили, что ремонт скоро закончится."],
    "mk": ["Храната се готви на место, а менито стои секој понеделник.", "Секој четврток децата имаат цртање во игралната.", "Документите за запишување се предаваат во канцеларијата.", "Новите деца плаќаат повеќе, а другите по старата цена.", "Прашавме за дворот и ни рекоа дека поправката ќе заврши."],
    "de": ["Das Essen wird vor Ort gekocht, und der Speiseplan hängt jeden Montag aus.", "Jeden Donnerstag steht für die Kinder Zeichnen auf dem Plan.", "Die Anmeldung muss im Sekretariat abgegeben werden.", "Neue Kinder zahlen mehr, für die anderen bleibt der alte Preis.", "Wir haben nach dem Hof gefragt, die Arbeiten enden bald."],
    "fr": ["Les repas sont préparés sur place et le menu est affiché chaque lundi.", "Chaque jeudi les enfants font du dessin dans la salle de jeux.", "Le dossier d'inscription doit être remis au secrétariat.", "Les nouveaux enfants paient plus, les autres gardent l'ancien prix.", "Nous avons demandé pour la cour, les travaux finiront bientôt."],
    "tr": ["Yemekler okulda pişirilir ve menü her pazartesi günü asılır.", "Her perşembe günü çocuklar için resim düzenleniyor.", "Kayıt belgeleri okul ofisine teslim edilmelidir.", "Yeni çocuklar daha çok öder, diğerleri eski fiyatı öder.", "Bahçeyi sorduk, tadilatın yakında biteceğini söylediler."],
    "es": ["La comida se prepara en el centro y el menú se cuelga cada lunes.", "Cada jueves los niños practican el dibujo con su maestra.", "La solicitud se entrega en la secretaría del centro.", "Los niños nuevos pagan más, los demás mantienen el precio.", "Preguntamos por el patio y nos dijeron que las obras acabarán pronto."],
}


@pytest.fixture(scope="module")
def sample():
    return [("\n".join(v[i:] + v[:i]), k) for k, v in LINES.items() for i in range(4)]


@pytest.fixture(scope="module")
def model(sample):
    return train(sample + [(LINES["bg"][0], "mk"), (LINES["bg"][1], "en")])


def test_held_out_lines(model):
    held = {"bg": "Автобусът тръгва от центъра и обикаля още няколко спирки в селото.", "en": "The bus leaves the centre and calls at several more stops in the village.", "ru": "Автобус отправляется из центра и делает ещё несколько остановок.", "mk": "Автобусот тргнува од центарот и застанува уште на неколку места во селото.", "de": "Der Bus fährt im Zentrum ab und hält noch an mehreren Stellen.", "fr": "Le car part du centre et fait encore plusieurs arrêts dans le village.", "tr": "Otobüs merkezden kalkar ve köyde birkaç durakta daha durur.", "es": "El autobús sale del centro y hace otras paradas en el pueblo."}
    right = [LANGUAGES[judge(model, [t])[0][0]] == k for k, t in held.items()]
    assert sum(right) >= 7
    assert LANGUAGES[judge(model, [latinized(LINES["bg"][2], 1)])[0][0]] == "bg"


def test_mixed_lines_quotes_and_wordless_texts(model):
    text = "\n".join([LINES["bg"][0], "", LINES["en"][1], LINES["bg"][3] + " „The Little Bakers of Every Monday Morning“", LINES["bg"][4]])
    lang, conf, found = judge(model, [text])[0]
    assert LANGUAGES[lang] == "bg" and [(n, LANGUAGES[k]) for n, k, _ in found] == [(3, "en")] and 0 <= conf <= 1
    assert judge(model, ["", "12 345 — !", "\n\n"]) == [None, None, None]
    assert plain("„цитат“\nтекст „цитат“") == "„цитат“\nтекст  "


def test_labels():
    assert [known_label(x) for x in ("bg-BG", "Bulgarian", "български", "EN", "deu", "xx", "", None, "n/a", "und")] == ["bg", "bg", "bg", "en", "de", None, None, None, None, None]


def test_tables(spark, sample):
    cols = "doc_id long, text string, lang string, line_no int, confidence double"
    rows = [(i, t, k, 5, 0.1) for i, (t, k) in enumerate(sample)]
    odd = [(100, LINES["bg"][0], "Bulgarian", 1, 0.0), (101, LINES["bg"][1], None, 1, 0.0), (102, LINES["en"][0], "fr", 1, 0.0), (103, None, "bg", 1, 0.0), (104, "42", None, 1, 0.0), (105, " ".join(LINES["de"]) * 2000, "", 1, 0.0)]
    df = spark.createDataFrame(rows + odd + odd[:2], cols)
    got = {(r.doc_id, r.line_no, r.lang) for r in found_languages(df).collect()}
    assert got == {(101, 0, "bg"), (102, 0, "en"), (105, 0, "de")}
    assert languages(spark.createDataFrame([], cols)).count() == 0
    assert languages(spark.createDataFrame([(1, LINES["bg"][0], None, 1, 0.0)], cols)).count() == 1


def test_confidences_hold_on_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_model(docs.filter("doc_id % 2 = 0"))
    # labels are noisy, so four words are held against what the whole text is told to be
    texts = [r.text for r in docs.filter("doc_id % 2 = 1 and length(text) > 200").collect()]
    whole = judge(model, texts)
    cut = judge(model, [" ".join(t.split()[5:9]) for t in texts])
    got = [(c[1], c[0] == w[0]) for c, w in zip(cut, whole) if c and w and len(w[2]) == 0]
    sure, other = [ok for c, ok in got if c >= 0.9], [ok for c, ok in got if c < 0.7]
    assert len(sure) > 50 and sum(sure) / len(sure) >= 0.9
    assert not other or sum(other) / len(other) < sum(sure) / len(sure)
