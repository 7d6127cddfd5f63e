"""Which library a file has built in, from its strings: banners, source paths, error names and corroborating symbols.

Strings are filtered map-side to the few that say anything before the one shuffle, by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.operators.parts import dealt

# Keywords in strings, banner patterns, and error names that one library alone has.
KEYWORDS = r"OpenSSL|BoringSSL|LibreSSL|boringssl/src/|-fvisibility=hidden|OPENSSLDIR:|ENGINESDIR:"
LOOSE = r"OpenSSL\s+(\d+\.\d+\.\d+[a-z]*(?:-[a-z0-9.]+)?(?:\+[a-z0-9.]+)?)"
STRICT = LOOSE + r"\s+\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}"
LIBRE = r"LibreSSL\s+(\d+\.\d+\.\d+)"
SOURCE = r"boringssl/src/(?:crypto|ssl)/"
ERRORS = """ECH_REJECTED NO_COMMON_SIGNATURE_ALGORITHMS CHANNEL_ID_NOT_P256 CHANNEL_ID_SIGNATURE_INVALID ALPS_MISMATCH_ON_EARLY_DATA
INVALID_ALPS_CODEPOINT NEGOTIATED_ALPS_WITHOUT_ALPN ECH_SERVER_WOULD_HAVE_NO_RETRY_CONFIGS COULD_NOT_PARSE_HINTS""".split()
# Weak symbols of which two are enough, and symbols that corroborate beside those drawn from the dimension.
WEAK = ["OPENSSL_memory_alloc", "OPENSSL_memory_free", "OPENSSL_memory_get_size"]
SENTINELS = """SSL_CTX_new SSL_connect EVP_EncryptInit EVP_DigestInit BIO_new_socket X509_free RSA_public_encrypt SHA256_Update
ERR_get_error OPENSSL_init_ssl RAND_bytes EC_KEY_new BN_CTX_new DH_generate_parameters_ex PEM_read_bio_PrivateKey HMAC_Init_ex""".split()
PER_CATEGORY, LENGTH, ENOUGH = 2, 12, 3


def probes(symbols: DataFrame) -> DataFrame:
    """Corroborating symbols: the first two long names of each category (symbol, category; `other` gives none) and the sentinels.

    A bounded table: two names a category.
    """
    spark = symbols.sparkSession
    first = F.row_number().over(Window.partitionBy("category").orderBy("symbol"))
    long = symbols.where((F.length("symbol") >= LENGTH) & (F.col("category") != "other")).select("symbol", "category").distinct()
    return long.withColumn("k", first).where(F.col("k") <= PER_CATEGORY).select("symbol").union(spark.createDataFrame([(s,) for s in SENTINELS], "symbol string")).distinct()


def banners(strings: DataFrame, probes: DataFrame, by: str = "file", text: str = "text") -> DataFrame:
    """One row per file that has any telling string: library and version found (null if none), signals, corroborating symbols.

    Of several versions in a file the smallest counts.
    """
    t = F.col(text)
    mark = probes.select(F.col("symbol").alias(text)).distinct().withColumn("is_probe", F.lit(True))
    keyed = strings.select(by, text, F.regexp_extract(t, KEYWORDS, 0).alias("kw")).join(mark, text, "left")
    telling = dealt(keyed.where((F.col("kw") != "") | t.isin(ERRORS) | F.col("is_probe")), by).distinct()
    kw = F.col("kw")
    version = lambda pattern, word: F.min(F.when(kw == word, F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))))
    n = telling.groupBy(by).agg(
        version(STRICT, "OpenSSL").alias("strict"),
        version(LOOSE, "OpenSSL").alias("loose"),
        version(LIBRE, "LibreSSL").alias("libre"),
        F.bool_or((kw == "BoringSSL") | ((kw == "OpenSSL") & t.contains("BoringSSL"))).alias("boring"),
        F.count_if((kw == "boringssl/src/") & t.rlike(SOURCE)).alias("sources"),
        F.count_if(t.isin(ERRORS)).alias("errors"),
        F.count_if(F.coalesce("is_probe", F.lit(False))).alias("n_corroborating"),
        F.bool_or(kw == "-fvisibility=hidden").alias("hidden"),
        F.bool_or(kw == "OPENSSLDIR:").alias("openssldir"),
        F.bool_or(kw == "ENGINESDIR:").alias("enginesdir"),
    )
    k, hidden, folder, engines = (F.col(c) for c in ("n_corroborating", "hidden", "openssldir", "enginesdir"))
    rule = (
        F.when(F.col("strict").isNotNull(), "version_banner_strict")
        .when(F.col("sources") >= 3, "boringssl_src_paths")
        .when(F.col("errors") >= 2, "boringssl_unique_errors")
        .when(F.col("boring") & ((k >= ENOUGH) | hidden), "boringssl_banner")
        .when(F.col("libre").isNotNull() & ((k >= ENOUGH) | hidden), "libressl_banner")
        .when(F.col("loose").isNotNull() & ((k >= ENOUGH) | ((hidden | folder | engines) & (k >= 1))), "version_banner_loose")
    )
    ruled = n.withColumn("rule", rule)
    r = F.col("rule")
    library = F.when(r.startswith("version_banner"), "OpenSSL").when(r.startswith("boringssl"), "BoringSSL").when(r == "libressl_banner", "LibreSSL")
    found = F.when(r == "version_banner_strict", F.col("strict")).when(r == "version_banner_loose", F.col("loose")).when(r == "libressl_banner", F.col("libre"))
    # a loose banner that other evidence already carries does not name the engines' folder
    by_folder = (r == "version_banner_loose") & (k < ENOUGH) & ~hidden
    signals = [r, F.when(hidden, "fvisibility_hidden"), F.when(folder & r.startswith("version_banner"), "openssldir"), F.when(engines & ((r == "version_banner_strict") | by_folder), "enginesdir"), F.when(k > 0, F.concat(F.lit("corroborating_symbols_"), k.cast("string")))]
    return ruled.select(by, r.isNotNull().alias("detected"), library.alias("library"), found.alias("version"), F.when(r.isNotNull(), F.sort_array(F.array_compact(F.array(*signals)))).alias("signals"), "n_corroborating", "hidden")


def weak_symbols(symbols: DataFrame, by: str = "file") -> DataFrame:
    """Files with two or more of the weak memory symbols."""
    return symbols.where(F.col("symbol").isin(WEAK)).groupBy(by).agg(F.countDistinct("symbol").alias("n")).where("n >= 2").select(by)


def library_vote(points: DataFrame, by: str = "file") -> DataFrame:
    """The library of most points (by, library, points); rows without library do not vote, a tie goes to the smaller name."""
    summed = points.groupBy(by, "library").agg(F.sum("points").alias("points"))
    named = summed.where("library is not null").groupBy(by).agg(F.min(F.struct((-F.col("points")).alias("p"), "library")).alias("m")).select(by, F.col("m.library").alias("library"))
    return points.select(by).distinct().join(named, by, "left").select(by, F.coalesce("library", F.lit("OpenSSL")).alias("library"))


def dlopen_level(resolved: Column, clustered: Column, raw: Column, strict: bool = False) -> Column:
    """Confidence of names loaded at run time, from how many were resolved, clustered, or only found among the strings."""
    sure = resolved + clustered > 0
    return F.when(sure, "high").when((raw > 0) & F.lit(not strict), "inferred").when(raw > 0, "low").otherwise("high")


def dlopen_symbols(raw: DataFrame, clustered: DataFrame, resolved: DataFrame, by: str = "file", strict: bool = False, enough: int = 5) -> DataFrame:
    """Names loaded at run time: by, symbol and confidence.  All inputs: by, symbol; raw holds all candidates among the strings.

    What machine code resolves counts where the file has clusters or enough candidates; where nothing is sure all
    candidates count as inferred, or none in strict mode.
    """
    keys = [by, "symbol"]
    marked = raw.distinct().join(clustered.distinct().withColumn("c", F.lit(1)), keys, "left").join(resolved.distinct().withColumn("r", F.lit(1)), keys, "left")
    n = marked.groupBy(by).agg(F.count("c").alias("n_c"), F.count("r").alias("n_r"), F.count("*").alias("n"))
    full = marked.join(n, by)
    by_code = F.when((F.col("n_c") > 0) | (F.col("n") >= enough), F.col("n_r")).otherwise(0)
    level = dlopen_level(by_code, F.col("n_c"), F.col("n"), strict)
    sure = F.col("c").isNotNull() | ((by_code > 0) & F.col("r").isNotNull())
    return full.select(by, "symbol", level.alias("confidence"), sure.alias("sure")).where((F.col("sure") & (F.col("confidence") == "high")) | (F.col("confidence") == "inferred")).drop("sure")
