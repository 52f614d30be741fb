"""Repair rules, the word tests and the anomaly test on known sentences."""

import pytest
from pyspark.sql import functions as F

from bookflow.functions import casing, rules
from bookflow.functions.lexicon import SUFFIXES, Lexicon, repair_split_words, suffixes
from bookflow.functions.literal_rules import clean_literal, has_anomaly

WORDS = "kitap düşünmek duş tarih anlatmak şans demek takla sarmalanmak kol fikir en iyi etmek onaylamak ayak olay masa ağrı dava görünmek".split()
EXACT = [
    ("Bu durum çok tuhaftır- ama yine de devam etti.", "Bu durum çok tuhaftır - ama yine de devam etti."),
    ("Onu bulamamıştım- sadece merak etmiştim.", "Onu bulamamıştım - sadece merak etmiştim."),
    ("Net hatırlayabiliyorum- sonunda bulduk.", "Net hatırlayabiliyorum - sonunda bulduk."),
    ("Araba geliyor- bitip gidecek.", "Araba geliyor - bitip gidecek."),
    ("Tarihi yapı- lamaz denilen surlar.", "Tarihi yapılamaz denilen surlar."),
    ("Tarihi yapı-<br/>lamaz denilen surlar.", "Tarihi yapılamaz denilen surlar."),
    ("Tarihi yapı-lamaz denilen surlar.", "Tarihi yapılamaz denilen surlar."),
    ("Bunu anla- madım çünkü zor.", "Bunu anlamadım çünkü zor."),
    ("Çocuk baş- ladı koşmaya.", "Çocuk başladı koşmaya."),
    ("Yeni öğ- renci geldi.", "Yeni öğrenci geldi."),
    ("Sürekli geliş- tirme yaptık.", "Sürekli geliştirme yaptık."),
    ("yarm sabah erkenden kalktı", "yarın sabah erkenden kalktı"),
    ("kamında ağrı vardı, bumu ağrıyor", "karnında ağrı vardı, burnu ağrıyor"),
    ("öğmeciler clünya turuna çıktı", "öğrenciler dünya turuna çıktı"),
    ("karamlık gecede imsanlar yürüdü", "karanlık gecede insanlar yürüdü"),
    ("tarnarn oldu ve zarnan geçti", "tamam oldu ve zaman geçti"),
    ("Eski bir tanıdığı andınyordu, sesini de andıryordu.", "Eski bir tanıdığı andırıyordu, sesini de andırıyordu."),
    ("Uzakta bir ışık görünrnüyordu, tükenrnez bir karanlık vardı.", "Uzakta bir ışık görünmüyordu, tükenmez bir karanlık vardı."),
    ("Evrende galaksi- sonsuz derinliğe uzanır.", "Evrende galaksi - sonsuz derinliğe uzanır."),
    ("Bunu açıkça yazdı- kimse itiraz etmedi.", "Bunu açıkça yazdı - kimse itiraz etmedi."),
    ("bir yıl . . . dönüp duruyordu.", "bir yıl... dönüp duruyordu."),
    ("Mladost 1 'deki evde oturduk.", "Mladost 1'deki evde oturduk."),
    ("uzun bir yürüyüş yaptık. 124 Ve ancak oturduk.", "uzun bir yürüyüş yaptık. Ve ancak oturduk."),
    ("Bir de göğsümü sıkıştırıyor... 2.", "Bir de göğsümü sıkıştırıyor..."),
    ("N de en gelmedi.,, Bu doğru deil.", "Neden gelmedi. Bu doğru değil."),
    ("g e l d i ve baladı konuşmaya.", "geldi ve başladı konuşmaya."),
    ('Kalktım ayağa. "İyi ş anslar."', 'Kalktım ayağa. "İyi şanslar."'),
    ("Çeyrek M, de ğil mi?", "Çeyrek M, değil mi?"),
    ('"Öyle mi?" dedim. "Onu mu kastettin, Rowan?"', '"Öyle mi?" dedim. "Onu mu kastettin, Rowan?"'),
    ("Gersh Andy'ye ayı ve güneşi vadedecek", "Gersh Andy'ye ayı ve güneşi vadedecek"),
    ("Hak etmedi ğimde bile bana hep iyi davranmıştı.", "Hak etmediğimde bile bana hep iyi davranmıştı."),
    ("O yüzden onaylama yışı dokunuyordu.", "O yüzden onaylamayışı dokunuyordu."),
    ("Sende ne fikir ler var, Rowan?", "Sende ne fikirler var, Rowan?"),
    ("dünyayı değiş tirmek istiyor.", "dünyayı değiştirmek istiyor."),
    ('"Faraday kesesi," dedi k aynı anda üçümüz birden.', '"Faraday kesesi," dedik aynı anda üçümüz birden.'),
    ("taklala r atıyordu.", "taklalar atıyordu."),
    ("yığını özenle bıraktı kolla rıma.", "yığını özenle bıraktı kollarıma."),
    ("CLAHA iyi, Claha iyi", "DAHA iyi, Daha iyi"),
    ("�imdi �ehirde BİR ÇOK ve Bir  çok", "şimdi şehirde BİR ÇOK ve Birçok"),
    ("not[^p45_1] burada , dedi", "not[^p45_1] burada, dedi"),
]


@pytest.fixture(scope="module")
def lexicon():
    return Lexicon(WORDS)


@pytest.fixture(scope="module")
def ruleset(lexicon):
    return rules.catalog(lexicon)


@pytest.mark.parametrize("text,want", EXACT)
def test_repair(text, want, ruleset, lexicon):
    assert rules.repair(text, ruleset, lexicon)[0] == want


@pytest.mark.parametrize("text,part", [("k i t a p l a r ı masaya bıraktı ve d ü ş ü n d ü.", "kitapları masaya"), ("k i t a p ve d ü ş ü n d ü.", "düşündü"), ("T ar i h i olayları a n l a t t ı.", "Tarihi olayları anlattı"), ("aklı en iyi karanlıkta çalışır.", "en iyi"), ("O tür açıklamalar", "O tür")])
def test_repair_contains(text, part, ruleset, lexicon):
    assert part in rules.repair(text, ruleset, lexicon)[0]


def test_there_are_92_rules_in_order(ruleset):
    assert [r[0] for r in ruleset] == list(range(1, 93))


def test_log_names_rule_and_change(ruleset, lexicon):
    cleaned, log = rules.repair("yarm sabah , dedi", ruleset, lexicon)
    assert cleaned == "yarın sabah, dedi"
    assert ("'yarm...' -> 'yarın...'", [("yarm", "yarın")]) in log and ("Noktalama öncesi boşluk düzeltmesi", [(" ,", ",")]) in log


def test_casing():
    assert casing.upper("iı") == "İI" and casing.lower("İI") == "iı"
    assert casing.keep_case("YARM", "yarın") == "YARIN" and casing.keep_case("Yarm", "yarın") == "Yarın"


def test_lexicon(lexicon):
    assert lexicon.is_valid("kitapları") and lexicon.is_valid("anlattı") and not lexicon.is_valid("zzzz")
    assert lexicon.is_valid("kitabı") and lexicon.stands_alone("mı") and not lexicon.stands_alone("q")
    assert len(suffixes()) == len(SUFFIXES) == 511 and [len(s) for s in suffixes()] == sorted(map(len, SUFFIXES), reverse=True)
    known = Lexicon(["gel", "gelmek"])
    assert all(known.is_valid(w) for w in ("gelebildi", "gelersin", "gelebiliyor", "geldiğinde"))
    assert not any(known.is_valid(w) for w in ("geleceksunuz", "gelyip"))
    assert repair_split_words("ab", lexicon) == ("ab", 0)


def test_repaired_frame(spark):
    rows = spark.createDataFrame([(1, "yarm geldi"), (2, None), (3, "yarm geldi"), (4, "temiz")], "id int, t string")
    out = {r.id: r for r in rules.repaired(rows, "t", WORDS).collect()}
    assert out[1].cleaned == out[3].cleaned == "yarın geldi" and out[2].cleaned is None and out[4].log == []
    assert rules.audit(rules.repaired(rows, "t", WORDS), ["id"]).count() == 2


def test_anomaly(spark):
    cases = [
        ("Bu tamamen temiz ve düzgün bir Türkçe cümledir.", False), ("Bu cümlede � bozuk karakter var.", True), ("N de en geldi ama olmadı", True),
        ("O da bir insandı ve ya da geldi.", False), ("Bozuk noktalama .,, vardı", True), ("krtklm buraya gelemez", True), ("Bir not[^p45_1] vardı", False),
        ("hâlâ kâğıt", False), ("kelimeDe hata", True), ("bir çok insan", True), ("", False), ("   ", False), (None, False),
    ]
    rows = spark.createDataFrame(cases, "t string, want boolean")
    assert [r for r in rows.withColumn("got", has_anomaly(F.col("t"))).collect() if r.got != r.want] == []


def test_literal_rules_match_the_engine(spark, lexicon):
    texts = [t for t, _ in EXACT]
    plain = [r for r in rules.catalog(lexicon) if r[0] in (1, 4, 13, 53, 54, 55, 56, 89, 90, 91, 92)]

    def by_hand(t):
        for _, _, pattern, to in plain:
            t = pattern.sub(to, t)
        return t

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in rows.select(clean_literal(F.col("t")).alias("c")).collect()] == [by_hand(t) for t in texts]
