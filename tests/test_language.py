from opinio.operators.language import identify_language, train_language_model, translate_with_memory


def test_translation_memory_routing(spark):
    df = spark.createDataFrame([("hello there", "en"), ("bonjour", "fr"), ("hola", "es")], "text_raw string, lang string")
    mem = spark.createDataFrame([("bonjour", "hi"), ("bonjour", "good morning"), ("hello there", "x"), (None, "y"),
                                 ("hola", None)], "text string, translated string")
    got = {r["text_raw"]: r["text_en"] for r in translate_with_memory(df, mem).collect()}
    assert got == {"hello there": "hello there", "bonjour": "good morning", "hola": "hola"}


def test_language_model_separates_languages(spark):
    en = ["the cat sat on the mat with the hat", "this is what they think about the weather",
          "when the rain comes we stay inside the house"] * 4
    fr = ["le chat est sur le tapis avec le chapeau", "ce que les gens pensent de la pluie",
          "quand la pluie arrive nous restons dans la maison"] * 4
    train = spark.createDataFrame([(t, "en") for t in en] + [(t, "fr") for t in fr], "text string, lang string")
    model = train_language_model(train)
    test = spark.createDataFrame([("the house with the cat",), ("la maison avec le chat",)], "text_raw string")
    got = [r["lang"] for r in identify_language(test, model).collect()]
    assert got == ["en", "fr"]


def test_probabilities_are_calibrated(spark):
    """Texts of which a share has the other label: the probability follows the share, where plain Naive Bayes is all but sure."""
    import math
    import random
    from opinio.operators.language import route_by_confidence
    from pyspark.sql import functions as F
    rnd = random.Random(1)
    words = {"en": ["the", "and", "with", "house", "rain"], "fr": ["les", "avec", "maison", "pluie", "dans"]}

    def sample(n):
        rows = []
        for _ in range(n):
            lang = rnd.choice(["en", "fr"])
            kind = lang if rnd.random() < 0.8 else ("fr" if lang == "en" else "en")
            rows.append((" ".join(rnd.choice(words[kind]) for _ in range(20)), lang))
        return spark.createDataFrame(rows, "text string, lang string")
    train, held, test = sample(300), sample(300), sample(400)
    plain, model = train_language_model(train), train_language_model(train, held_out=held)
    assert model.temperature > 5 and plain.temperature == 1.0

    def loss(m):
        out = identify_language(test.withColumnRenamed("lang", "label"), m, "text", "lang", "p").cache()
        hit = F.when(F.col("lang") == F.col("label"), F.col("p")).otherwise(1 - F.col("p"))
        return out.agg(F.avg("p"), F.avg((F.col("lang") == F.col("label")).cast("double")), F.avg(-F.log(F.greatest(hit, F.lit(1e-12))))).first()
    p, accuracy, calibrated = loss(model)
    assert abs(p - accuracy) < 0.06 and 0.7 < accuracy < 0.9
    assert calibrated < loss(plain)[2] and calibrated < 0.6 < math.log(2)
    df = spark.createDataFrame([("en", 0.95), ("en", 0.5), ("fr", 0.5)], "lang string, p double")
    assert [r[0] for r in df.select(route_by_confidence(F.col("lang"), F.col("p"))).collect()] == ["en", "unsure", "fr"]
    null = spark.createDataFrame([(None,), ("",)], "text string")
    assert identify_language(null, model, "text", "lang", "p").where("p between 0 and 1").count() == 2
