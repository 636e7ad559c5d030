"""What senders share in their posts: URLs, domains, keywords, key phrases."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.errors import ConfigurationError, ValidationError, validate_parameter
from netspark.functions.urls import URL, normalize_url, strip_trailing, url_host
from netspark.session import small

TOKEN = r"(?U)\b\w+\b"
#: Languages of stop words that Spark brings along.
STOP_LANGUAGES = {"da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish"}
SNOWBALL = {"ar": "arabic", "da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "el": "greek", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ro": "romanian", "ru": "russian", "es": "spanish", "sv": "swedish"}


def validate_posts(df: DataFrame, sender_col: str, post_col: str, datetime_col: str | None) -> None:
    missing = [c for c in (sender_col, post_col, datetime_col) if c and c not in df.columns]
    if missing:
        raise ValidationError(f"posts lack {missing}", field="df", value=df.columns)
    if not isinstance(df.schema[post_col].dataType, T.StringType):
        raise ValidationError("posts must be strings", field=post_col, value=df.schema[post_col].dataType.simpleString())


def extract_urls(df: DataFrame, sender_col: str = "sender", post_col: str = "post", datetime_col: str | None = "datetime", url_col: str = "url", normalize: bool = True) -> DataFrame:
    """``sender, datetime, url``: each post's distinct URLs, canonical unless normalize is off.

    Distinctness within a post is an array operation, so nothing is shuffled.
    """
    validate_posts(df, sender_col, post_col, datetime_col)
    found = F.regexp_extract_all(F.col(post_col), F.lit(URL), F.lit(0))
    clean = F.array_distinct(F.transform(found, normalize_url if normalize else strip_trailing))
    carry = [c for c in (sender_col, datetime_col) if c]
    return df.select(*carry, F.explode(clean).alias(url_col)).where(F.col(url_col) != "")


def extract_domains(df: DataFrame, sender_col: str = "sender", post_col: str = "post", datetime_col: str | None = "datetime", domain_col: str = "domain", strip_www: bool = True, normalize: bool = True) -> DataFrame:
    """``sender, datetime, domain``: the host of each of a post's distinct URLs."""
    urls = extract_urls(df, sender_col, post_col, datetime_col, "__url", normalize)
    carry = [c for c in (sender_col, datetime_col) if c]
    return urls.select(*carry, url_host(F.col("__url"), strip_www).alias(domain_col)).where(F.col(domain_col) != "")


def get_stop_words(language: str, spark: Any = None) -> set[str]:
    """Stop words of a language by its two letters or name."""
    from pyspark.ml.feature import StopWordsRemover

    name = STOP_LANGUAGES.get(language.lower(), language.lower())
    if name not in STOP_LANGUAGES.values():
        raise ConfigurationError(f"there are no stop words for {language!r}", parameter="language", value=language, valid_options=sorted(STOP_LANGUAGES))
    return {w.lower() for w in StopWordsRemover.loadDefaultStopWords(name)}


def resolve_stop_words(stop_words: bool | str | Iterable[str], language: str | None) -> set[str]:
    """None for False; the language's for True; a named language's; or the given words in lower case."""
    if stop_words is False or stop_words is None:
        return set()
    if stop_words is True:
        if not language:
            raise ConfigurationError("stop_words=True needs a language", parameter="language")
        return get_stop_words(language)
    if isinstance(stop_words, str):
        return get_stop_words(stop_words)
    return {w.lower() for w in stop_words}


def _optional(module: str, purpose: str) -> Any:
    try:
        return importlib.import_module(module)
    except ImportError as error:
        raise ConfigurationError(f"{purpose} needs the package {module}", parameter=module, cause=error) from error


def make_stemmer(language: str) -> Callable[[str], str]:
    """A Snowball stemmer, if its package is installed."""
    if language not in SNOWBALL:
        raise ConfigurationError(f"there is no stemmer for {language!r}", parameter="language", value=language, valid_options=sorted(SNOWBALL))
    return _optional("snowballstemmer", "stemming").stemmer(SNOWBALL[language]).stemWord


def make_lemmatizer(language: str) -> Callable[[str], str]:
    """A lemmatiser, if its package is installed."""
    lemma = _optional("simplemma", "lemmatising").lemmatize
    return lambda w: lemma(w, lang=language)


def detect_majority_language(df: DataFrame, post_col: str, sample_size: int = 1000, seed: int = 42, detector: Callable[[str], str | None] | None = None) -> str:
    """The most frequent language of a seeded sample of posts, by the given detector or the package langdetect."""
    if detector is None:
        module = _optional("langdetect", "language detection")
        module.DetectorFactory.seed = seed
        detector = module.detect
    texts = [r[0] for r in df.where(F.length(F.trim(post_col)) > 0).orderBy(F.rand(seed)).limit(sample_size).select(post_col).collect()]
    votes = pd.Series([x for x in (detector(t) for t in texts) if x])
    if votes.empty:
        raise ValidationError("no post has a language that can be told", field=post_col)
    counts = votes.value_counts()
    return min(counts[counts == counts.max()].index)


def _word_map(words: Callable[[str], str] | None, column: Column) -> Column:
    return column if words is None else F.pandas_udf(lambda s: s.map(words), "string")(column)


def preprocess_keyword_list(keywords: Iterable[str], case_sensitive: bool, word_map: Callable[[str], str] | None) -> list[str]:
    """The vocabulary as tokens become; several words in one entry are an error."""
    out = []
    for k in keywords:
        tokens = re.findall(r"\b\w+\b", k)
        if len(tokens) != 1:
            raise ValidationError(f"{k!r} isn't a single word", field="keywords", value=k)
        w = tokens[0] if case_sensitive else tokens[0].lower()
        out.append(word_map(w) if word_map else w)
    return sorted(set(out))


def extract_keywords(df: DataFrame, keywords: Iterable[str] | None = None, *, sender_col: str = "sender", post_col: str = "post", datetime_col: str | None = "datetime", keyword_col: str = "keyword", output: str = "aggregated", count_col: str = "mentions", first_seen_col: str = "first_seen", case_sensitive: bool = False, method: str = "all", top_n: int | tuple[int, int] = 50, max_phrase_length: int = 3, stop_words: bool | str | Iterable[str] = False, stem: bool | Callable[[str], str] = False, lemmatize: bool | Callable[[str], str] = False, min_word_length: int = 1, language: str | None = None, language_sample_size: int = 1000, language_sample_seed: int = 42) -> DataFrame:
    """Tokens, or RAKE's key phrases, that senders use.

    ``aggregated`` gives ``sender, keyword, mentions, first_seen``; ``long`` and
    ``lazy`` give a row per occurrence. Tokens are made and filtered by column
    functions; stemmers and lemmatisers see distinct words only, after the
    first aggregation.
    """
    validate_posts(df, sender_col, post_col, datetime_col)
    validate_parameter(output, ["aggregated", "long", "lazy"], "output")
    validate_parameter(method, ["all", "rake"], "method")
    if method == "rake" and (keywords is not None or output != "aggregated"):
        raise ConfigurationError("rake has no vocabulary and only aggregated output", parameter="method", value=method)
    if stem and lemmatize:
        raise ConfigurationError("choose stemming or lemmatising", parameter="stem")
    if min_word_length < 1 or max_phrase_length < 1:
        raise ConfigurationError("lengths must be positive", parameter="min_word_length", value=min_word_length)
    needs = (stop_words is True or stem is True or lemmatize is True) and language is None
    language = detect_majority_language(df, post_col, language_sample_size, language_sample_seed) if needs else language
    stops = resolve_stop_words(stop_words, language)
    word_map = stem if callable(stem) else lemmatize if callable(lemmatize) else make_stemmer(language) if stem else make_lemmatizer(language) if lemmatize else None
    if method == "rake":
        return rake(df, sender_col, post_col, datetime_col, keyword_col, count_col, first_seen_col, case_sensitive, top_n, max_phrase_length, min_word_length, stops, word_map)
    carry = [c for c in (sender_col, datetime_col) if c]
    text = F.col(post_col) if case_sensitive else F.lower(F.col(post_col))
    tokens = df.select(*carry, F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias(keyword_col))
    k = F.col(keyword_col)
    if min_word_length > 1:
        tokens = tokens.where(F.char_length(k) >= min_word_length)
    if stops:
        tokens = tokens.where(~F.lower(k).isin(sorted(stops)))
    vocabulary = None if keywords is None else preprocess_keyword_list(keywords, case_sensitive, word_map)
    spark = df.sparkSession
    if word_map is None and vocabulary is not None:
        tokens = tokens.join(small(spark.createDataFrame([(w,) for w in vocabulary], f"`{keyword_col}` string")), keyword_col, "left_semi").select(*carry, keyword_col)
    if output != "aggregated":
        out = tokens.withColumn(keyword_col, _word_map(word_map, k))
        return out if vocabulary is None or word_map is None else out.where(k.isin(vocabulary))
    first = [F.min(datetime_col).alias(first_seen_col)] if datetime_col else []
    out = tokens.groupBy(sender_col, keyword_col).agg(F.count("*").alias(count_col), *first)
    if word_map is not None:
        again = [F.min(first_seen_col).alias(first_seen_col)] if datetime_col else []
        out = out.withColumn(keyword_col, _word_map(word_map, k)).groupBy(sender_col, keyword_col).agg(F.sum(count_col).alias(count_col), *again)
        out = out if vocabulary is None else out.where(k.isin(vocabulary))
    return out


def phrases(text: Column, stops: set[str], min_word_length: int, case_sensitive: bool) -> Column:
    """RAKE's candidates as an array: runs of words between punctuation, stop words and short words, each joined by spaces."""
    base = text if case_sensitive else F.lower(text)
    barred = F.array(*[F.lit(s) for s in sorted(stops)]) if stops else F.array().cast("array<string>")

    def run(segment: Column) -> Column:
        words = F.regexp_extract_all(segment, F.lit(TOKEN), F.lit(0))
        marked = F.transform(words, lambda w: F.when((F.char_length(w) >= min_word_length) & ~F.array_contains(barred, F.lower(w)), w).otherwise(F.lit("\x01")))
        return F.filter(F.transform(F.split(F.array_join(marked, " "), "\x01"), lambda p: F.trim(p)), lambda p: p != "")

    return F.flatten(F.transform(F.split(base, r"(?U)[^\w\s]+"), run))


def phrase_scores(counts: DataFrame, phrase: str, count: str) -> DataFrame:
    """``phrase, score``: the sum over words of degree over frequency, from phrases' total counts."""
    totals = counts.groupBy(F.col(phrase).alias("__p")).agg(F.sum(count).alias("n"))
    words = totals.select("__p", "n", F.explode(F.split("__p", " ")).alias("w"), F.size(F.split("__p", " ")).alias("len"))
    word = words.groupBy("w").agg((F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("s"))
    return words.join(word, "w").groupBy("__p").agg(F.sum("s").alias("score")).withColumnRenamed("__p", phrase)


def elastic_caps(df: DataFrame, sender_col: str, low: int, high: int) -> DataFrame:
    """``sender, cap``: from low to high by the average rank of a sender's number of posts; a single sender has high. Counts are ranked, not senders."""
    posts = df.groupBy(sender_col).agg(F.count("*").alias("__c"))
    sizes = posts.groupBy("__c").agg(F.count("*").alias("__m"))
    upto = F.sum("__m").over(Window.orderBy("__c"))
    ranks = sizes.select("__c", (upto - (F.col("__m") - 1) / 2).alias("__r"))
    n = sizes.agg(F.sum("__m").alias("__n"))
    cap = F.when(F.col("__n") == 1, F.lit(float(high))).otherwise(F.lit(low) + F.lit(high - low) * F.try_divide(F.col("__r") - 1, F.col("__n") - 1))
    return posts.join(ranks, "__c").crossJoin(F.broadcast(n)).select(sender_col, F.round(cap).cast("int").alias("cap"))


def rake(df: DataFrame, sender_col: str, post_col: str, datetime_col: str | None, keyword_col: str, count_col: str, first_seen_col: str, case_sensitive: bool, top_n: int | tuple[int, int], max_phrase_length: int, min_word_length: int, stops: set[str], word_map: Callable[[str], str] | None = None) -> DataFrame:
    """Each sender's best phrases: those within the length first, then by score, count and alphabet, up to top_n or an elastic cap."""
    carry = [c for c in (sender_col, datetime_col) if c]
    if word_map is None:
        found = phrases(F.col(post_col), stops, min_word_length, case_sensitive)
    else:
        def extract(texts: pd.Series) -> pd.Series:
            def one(text: str | None) -> list[str]:
                out: list[str] = []
                for segment in re.split(r"[^\w\s]+", text or ""):
                    run: list[str] = []
                    for w in [*re.findall(r"\b\w+\b", segment), ""]:
                        w = word_map(w if case_sensitive else w.lower()) if w else ""
                        if w and w.lower() not in stops and len(w) >= min_word_length:
                            run.append(w)
                        elif run:
                            out.append(" ".join(run))
                            run = []
                return out

            return texts.map(one)

        found = F.pandas_udf(extract, "array<string>")(F.col(post_col))
    first = [F.min(datetime_col).alias(first_seen_col)] if datetime_col else []
    counts = df.select(*carry, F.explode(found).alias(keyword_col)).groupBy(sender_col, keyword_col).agg(F.count("*").alias(count_col), *first)
    scored = counts.join(phrase_scores(counts, keyword_col, count_col), keyword_col)
    short = F.size(F.split(keyword_col, " ")) <= max_phrase_length
    rank = F.row_number().over(Window.partitionBy(sender_col).orderBy(short.desc(), F.desc(F.round("score", 9)), F.desc(count_col), F.asc(keyword_col)))
    ranked = scored.withColumn("__rank", rank)
    if isinstance(top_n, tuple):
        kept = ranked.join(elastic_caps(df, sender_col, *top_n), sender_col).where("__rank <= cap").drop("cap")
    else:
        kept = ranked.where(F.col("__rank") <= top_n)
    return kept.select(sender_col, keyword_col, count_col, *([first_seen_col] if datetime_col else []))
