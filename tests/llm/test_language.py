import numpy as np
import pytest
from pyspark.sql import functions as F

from paleoline.llm import language as lg
from tests.conftest import rows

WORDS = {
    "la": "voluntatis dominium iustitiae restitutionem quod enim peccatum autem legibus sententia".split(), "es": "voluntad señor justicia porque tambien pagaron mandaron obligacion reynos hallaron".split(),
    "it": "volontà giustizia popoli mandarono dichiarazione negozio prezzi ragioni guardava sentenze".split(), "fr": "volonté seigneurie iustice marchands couſtume donnerent querelles notaires chemin obligez".split(),
    "pt": "vontade senhor justiça mercadores obrigação conselho perdoaram também petição reinos".split(), "de": "gerechtigkeit obrigkeiten kauffmann verkauffung landschafft gewohnheit richteren urtheil geschlecht wahrheiten".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def table(make_lines):
    rng = np.random.default_rng(1)
    data = [{"id": f"{lang}{k:03d}", "lang": [lang.upper() if k % 3 else lang], "source_sic": text(rng, lang, 8)} for lang in lg.LANGUAGES for k in range(60)]
    data += [{"id": "no-label", "lang": None, "source_sic": text(rng, "it", 7)}, {"id": "wrong", "lang": ["de-DE"], "source_sic": text(rng, "la", 7)}, {"id": "mixed", "lang": ["la"], "source_sic": text(rng, "la", 6) + " " + text(rng, "fr", 6)}]
    data += [{"id": "two-words", "lang": ["es"], "source_sic": text(rng, "la", 5) + " señor porque"}, {"id": "short", "lang": ["es"], "source_sic": "quod enim"}, {"id": "null", "source_sic": None}, {"id": "empty", "source_sic": "", "lang": []}, {"id": None, "source_sic": "quod"}]
    data += [{"id": "three", "lang": ["lat", "und", ""], "source_sic": text(rng, "la", 400)}, {"id": "old", "lang": ["de"], "source_sic": text(rng, "la", 6), "file_pos": -5}, {"id": "old", "lang": ["la"], "source_sic": text(rng, "la", 6)}]
    return make_lines(data)


def test_held_out_lines_and_segments(spark, table):
    found = lg.line_languages(table, lg.train(table)).cache()
    got = {r["id"]: r for r in found.collect()}
    plain = [r for i, r in got.items() if i[:2] in lg.LANGUAGES and len(i) == 5]
    assert np.mean([r["langs"] == [r["id"][:2]] for r in plain]) > 0.97
    assert [s["lang"] for s in got["mixed"]["segments"]] == ["la", "fr"] and got["mixed"]["segments"][0]["end"] == 6
    assert got["null"]["langs"] == [] and got["empty"]["n_words"] == 0 and None not in got
    wrong = {(r["id"], r["lang"]) for r in lg.wrong_labels(found).collect()}
    assert {("no-label", "it"), ("wrong", "la"), ("mixed", "la"), ("mixed", "fr"), ("two-words", "la")} <= wrong
    assert not {"short", "three", "old", "null", "empty"} & {i for i, _ in wrong}


def test_labels(spark):
    df = spark.createDataFrame([(["LA-Latn", "lat", None, "und"],), (None,), ([],), (["es_ES", "por", ""],), (["zxx", "mul"],)], "lang array<string>")
    assert [r[0] for r in df.select(lg.label_set(F.col("lang"))).collect()] == [["la"], [], [], ["es", "pt"], []]


def test_segments_against_brute_force():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        e = np.log(rng.dirichlet(np.ones(3), n)).astype(np.float32)
        got = lg.segment([e], least=2, switch=1.0)[0]

        def score(lab):
            runs = [len(list(g)) for _, g in itertools.groupby(lab)]
            if len(runs) > 1 and min(runs) < 2:
                return -np.inf
            return sum(e[k, c] for k, c in enumerate(lab)) - (len(runs) - 1)

        best = max(score(lab) for lab in itertools.product(range(3), repeat=n))
        assert abs(score(tuple(got)) - best) < 1e-4


def test_empty_table(spark, make_lines):
    df = make_lines([])
    assert rows(lg.wrong_labels(lg.line_languages(df))) == []


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van",
    "Alla människor är födda fria och lika i värde och rättigheter", "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren", "Все люди рождаются свободными и равными в своем достоинстве",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "The brown dog jumped over what was left behind the kitchen window",
]


def test_foreign_and_scrambled_text_is_rejected(spark, table):
    rng = np.random.default_rng(9)
    scrambled = [" ".join("".join(rng.permutation(list(w))) for w in text(rng, lang, 8).split()) for lang in lg.LANGUAGES for _ in range(8)]
    model = lg.train(table)
    df = spark.createDataFrame([(str(k), None, t) for k, t in enumerate(FOREIGN + scrambled)], "id string, labels array<string>, text string")
    n = und = 0
    for r in lg.identify(df, model).collect():
        for s in r["segments"]:
            n, und = n + s["end"] - s["start"], und + (s["end"] - s["start"]) * (s["lang"] == "und")
    assert und >= 0.95 * n
    own = spark.createDataFrame([(lang, None, text(rng, lang, 9)) for lang in lg.LANGUAGES], "id string, labels array<string>, text string")
    assert all(r["langs"] == [r["id"]] for r in lg.identify(own, model).collect())


def test_confidence_is_reliable(spark, make_lines):
    """In every tenth of confidence, about that share of lines of words that languages share is right; some labels are wrong."""
    rng = np.random.default_rng(3)
    shared = "con de en que la per se non".split()
    odds = {lang: rng.dirichlet(np.full(len(shared), 2.0)) for lang in lg.LANGUAGES}

    def line(lang):
        own = rng.random(5) < 0.12
        return " ".join(rng.choice(WORDS[lang]) if o else rng.choice(shared, p=odds[lang]) for o in own)

    data = [{"id": f"{lang}{k:04d}", "lang": [lang if rng.random() > 0.03 else str(rng.choice(lg.LANGUAGES))], "source_sic": line(lang)} for lang in lg.LANGUAGES for k in range(700)]
    model = lg.train(make_lines(data))
    df = spark.createDataFrame([(f"{lang}{k}", None, line(lang)) for lang in lg.LANGUAGES for k in range(300)], "id string, labels array<string>, text string")
    got = [(s["confidence"], s["lang"] == r["id"][:2]) for r in lg.identify(df, model).collect() for s in r["segments"][:1] if len(r["segments"]) == 1 and s["lang"] != "und"]
    conf, right = np.array([c for c, _ in got]), np.array([x for _, x in got])
    bins = np.minimum((conf * 10).astype(int), 9)
    table = [(b, float(conf[bins == b].mean()), float(right[bins == b].mean()), int((bins == b).sum())) for b in np.unique(bins)]
    assert len(got) > 800 and sum(abs(c - a) * n for _, c, a, n in table) / len(got) < 0.08, table
