"""Answers: normal forms, parsing and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, words and limits of scoring.
ABSTENTIONS = ("not answerable", "unanswerable", "cannot be determined", "cannot be answered", "not enough information", "insufficient_evidence")
YES, NO = ("yes", "true", "correct"), ("no", "false", "incorrect")
TOLERANCE, SIMILAR, ANLS = 0.05, 0.8, 0.5


def normal(text: Column) -> Column:
    """Lower case without lead-ins, most punctuation and articles."""
    text = F.trim(F.lower(text))
    for lead in ("the answer is", "answer:", "answer is"):
        text = F.when(F.startswith(text, F.lit(lead)), F.trim(F.substring(text, F.lit(len(lead) + 1), F.length(text)))).otherwise(text)
    text = F.regexp_replace(text, r"(?U)[^\w\s.\-%]", "")
    text = F.regexp_replace(text, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal(text), " "), lambda x: x != ""))


def token_f1(prediction: Column, gold: Column) -> Column:
    p, g = words(prediction), words(gold)
    both = F.size(F.array_intersect(p, g))
    f1 = 2.0 * (both / F.size(p)) * (both / F.size(g)) / (both / F.size(p) + both / F.size(g))
    return F.when(F.size(g) == 0, (F.size(p) == 0).cast("double")).when((F.size(p) == 0) | (both == 0), 0.0).otherwise(f1)


def similarity(left: Column, right: Column) -> Column:
    left, right = F.lower(F.trim(left)), F.lower(F.trim(right))
    most = F.greatest(F.length(left), F.length(right))
    return F.when(most == 0, 1.0).when((F.length(left) == 0) | (F.length(right) == 0), 0.0).otherwise(1.0 - F.levenshtein(left, right) / most)


def anls(left: Column, right: Column) -> Column:
    s = similarity(left, right)
    return F.when(s >= ANLS, s).otherwise(0.0)


def boolean(text: Column) -> Column:
    t = words(text)
    yes, no = (F.arrays_overlap(t, F.array(*[F.lit(w) for w in k])) for k in (YES, NO))
    return F.when(yes != no, yes)


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def number(text: Column) -> Column:
    """The first power, else fraction, else number of a text, white space aside."""
    plain = r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)"
    power, over = rf"({plain})\^([-+]?\d+)", rf"({plain})/({plain})"

    def single(s: Column) -> Column:
        short = s.contains(",") & ~s.contains(".") & (F.length(F.regexp_replace(s, "^[^,]*,", "")) <= 2)
        return F.when(short, F.concat(F.substring_index(s, ",", 1), F.lit("."), F.substring_index(s, ",", -1))).otherwise(F.replace(s, F.lit(","), F.lit(""))).try_cast("double")

    def first(t: Column) -> Column:
        get = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("double")
        found = F.regexp_extract(t, r"[-+]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)(?:[eE][-+]?\d+)?", 0)
        powers, fractions = t.contains("^") & t.rlike(power), t.contains("/") & t.rlike(over)
        return F.when(powers, F.pow(get(power, 1), get(power, 2))).when(fractions, F.try_divide(get(over, 1), get(over, 2))).otherwise(_bound(found, single))

    return _bound(F.replace(text, F.lit(" "), F.lit("")), first)


def accuracy(prediction: Column, gold: Column, kind: Column) -> Column:
    p, g = normal(prediction), normal(gold)
    gives_up = F.lit(False)
    for phrase in ABSTENTIONS:
        gives_up = gives_up | p.contains(phrase)
    close = lambda x, y: F.when(x.isNull() | y.isNull(), False).when(y == 0, F.abs(x) < 1e-6).otherwise(F.abs(x - y) / F.abs(y) <= TOLERANCE)
    near = _bound(F.struct(number(prediction).alias("x"), number(gold).alias("y")), lambda v: close(v["x"], v["y"]))
    option = lambda t: F.regexp_extract(F.upper(F.trim(t)), r"\b([A-D])\b", 1)
    choice = (option(prediction) != "") & (option(prediction) == option(gold))
    truth = F.coalesce(boolean(prediction) == boolean(gold), F.lit(False))
    entity = ((g != "") & F.contains(p, g)) | (similarity(p, g) >= SIMILAR)
    found = F.when(kind == "unanswerable", gives_up).when(kind == "boolean", truth).when(kind.isin("numeric", "percentage"), near).when(kind == "single_choice", choice).otherwise(entity)
    return found.cast("double")


def answer_type(answerable: Column, form: Column, rule: Column) -> Column:
    return (
        F.when(~answerable | (form == "None"), "unanswerable").when(rule == "choice_exact_match", "single_choice").when(rule == "percentage_exact", "percentage")
        .when(form.isin("Int", "Float") | rule.contains("numeric") | rule.contains("tolerance"), "numeric").when(form.isin("Bool", "Boolean"), "boolean").otherwise("entity")
    )


def response_cost(tokens_in: Column, cached: Column, tokens_out: Column, price_in: float, price_cached: float, price_out: float) -> Column:
    """Price of a call, prices by the million tokens."""
    return ((tokens_in - cached) * price_in + cached * price_cached + tokens_out * price_out) / 1_000_000
