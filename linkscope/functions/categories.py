"""Symbol categories by ordered prefixes: the first category whose prefix fits decides."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of library files, and categories with their prefixes in the order in which they are tried.
LIBRARY_PREFIXES = [
    "libcrypto.", "libcrypto-", "libcrypto_", "libssl.", "libssl-", "libssl_", "libcrypto_openssl", "libssl_openssl",
    "libopenssl", "libboringssl", "libboringcrypto", "libhissl.", "libhissl_", "libssl_openssl_ohos",
]
PREFIXES = {
    "ssl_core": ["SSL_"],
    "ssl_tls": ["TLS_", "DTLS_", "TLSv1_", "DTLSv1_"],
    "crypto_evp": ["EVP_"],
    "crypto_rsa": ["RSA_", "RSAPrivateKey_", "RSAPublicKey_"],
    "crypto_dsa": ["DSA_", "DSAparams_"],
    "crypto_dh": ["DH_", "DHparams_"],
    "crypto_ec": ["EC_", "ECDSA_", "ECDH_", "ED25519_", "ED448_", "X25519_", "X448_", "ECParameters_", "ECPKParameters_", "ECPARAMETERS_", "ECPKPARAMETERS_"],
    "crypto_aes": ["AES_"],
    "crypto_des": ["DES_"],
    "crypto_chacha": ["CHACHA_", "POLY1305_"],
    "crypto_hash": ["SHA1_", "SHA224_", "SHA256_", "SHA384_", "SHA512_", "SHA3_", "MD4_", "MD5_", "RIPEMD160_", "BLAKE2_", "WHIRLPOOL_", "MDC2_", "SHA1", "SHA224", "SHA256", "SHA384", "SHA512", "MD4", "MD5", "MDC2", "RIPEMD160", "WHIRLPOOL"],
    "crypto_hmac": ["HMAC_", "CMAC_", "GMAC_", "SIPHASH_", "HMAC"],
    "crypto_bn": ["BN_"],
    "crypto_bio": ["BIO_"],
    "crypto_pem": ["PEM_"],
    "crypto_asn1": ["ASN1_", "d2i_", "i2d_", "a2i_", "a2d_", "b2i_", "i2a_", "i2b_", "i2o_", "i2s_", "i2t_", "i2v_", "o2i_", "s2i_", "v2i_", "asn1_", "INT32_", "INT64_", "UINT32_", "UINT64_", "LONG_", "BIGNUM_", "CBIGNUM_", "ZINT32_", "ZINT64_", "ZLONG_", "ZUINT32_", "ZUINT64_"],
    "crypto_x509": ["X509_", "X509V3_", "X509v3_", "X509at_"],
    "crypto_x509_ext": ["GENERAL_", "PROFESSION_", "ADMISSIONS_", "ADMISSION_", "NAMING_", "SXNET_", "SXNETID_", "DIST_", "POLICY_", "AUTHORITY_", "PROXY_", "NAME_", "OTHERNAME_", "ACCESS_", "BASIC_", "ISSUER_", "ISSUING_", "EXTENDED_", "NOTICEREF_", "POLICYINFO_", "POLICYQUALINFO_", "USERNOTICE_", "CERTIFICATEPOLICIES_", "EDIPARTYNAME_", "DIRECTORYSTRING_", "DISPLAYTEXT_", "CRL_", "PKEY_", "ASIdOrRange_", "ASIdentifierChoice_", "ASIdentifiers_", "ASRange_", "IPAddressChoice_", "IPAddressFamily_", "IPAddressOrRange_", "IPAddressRange_"],
    "crypto_pkcs": ["PKCS7_", "PKCS12_", "PKCS5_", "PKCS8_", "PKCS1_", "PBE2PARAM_", "PBEPARAM_", "PBKDF2PARAM_", "PBMAC1PARAM_", "PBMAC1_"],
    "crypto_cms": ["CMS_"],
    "crypto_ocsp": ["OCSP_"],
    "crypto_ts": ["TS_"],
    "crypto_ct": ["CT_", "SCT_", "CTLOG_"],
    "crypto_rand": ["RAND_"],
    "crypto_err": ["ERR_", "err_"],
    "crypto_obj": ["OBJ_"],
    "crypto_engine": ["ENGINE_"],
    "crypto_provider": ["OSSL_PROVIDER_", "OSSL_PARAM_", "OSSL_STORE_"],
    "crypto_kdf": ["HKDF_", "PBKDF2_", "SCRYPT_", "KDF_"],
    "crypto_sm": ["SM2_", "SM3_", "SM4_"],
    "crypto_conf": ["CONF_", "NCONF_", "conf_"],
    "crypto_ui": ["UI_"],
    "crypto_srp": ["SRP_"],
    "crypto_async": ["ASYNC_"],
    "crypto_comp": ["COMP_"],
    "crypto_smime": ["SMIME_", "ESS_"],
    "crypto_legacy": ["Camellia_", "BF_", "IDEA_", "CAST_", "RC2_", "SEED_", "RC4_", "RC4"],
    "crypto_netscape": ["NETSCAPE_"],
    "crypto_dso": ["DSO_"],
    "openssl_util": ["OPENSSL_", "OSSL_", "CRYPTO_", "OpenSSL_", "BUF_", "TXT_", "UTF8_"],
}
TIER_1 = ["ssl_core", "ssl_tls", "crypto_evp", "crypto_bio", "crypto_pem", "crypto_x509", "crypto_x509_ext", "crypto_pkcs", "crypto_cms", "crypto_ocsp", "crypto_ct", "crypto_engine", "crypto_provider", "openssl_util"]
TIER_3 = ["crypto_aes", "crypto_des", "crypto_chacha", "crypto_hash", "crypto_hmac", "crypto_bn", "crypto_rand", "crypto_legacy"]
#: The category of user-supplied symbols, spelt as the data contract has it.
CUSTOM = "COSTOM"


def first_fit(symbol: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first of the rules (prefix, name) that fits, or null.

    The prefixes are halved in their order as texts, where none of the lower half begins one of the upper, so a symbol is held against few of them.
    """
    order = sorted(p for p, _ in rules)
    whole = [i for i in range(1, len(order)) if not any(order[i].startswith(p) for p in order[:i])]
    if len(rules) > 4 and whole:
        middle = order[min(whole, key=lambda i: abs(2 * i - len(order)))]
        return F.when(symbol < middle, first_fit(symbol, [r for r in rules if r[0] < middle])).otherwise(first_fit(symbol, [r for r in rules if r[0] >= middle]))
    out = F.when(F.lit(False), "")
    for p, name in rules:
        out = out.when(symbol.startswith(p), name)
    return out


def category_of(symbol: Column, rules: Mapping[str, list[str]] = PREFIXES, custom: Iterable[str] = (), macros: Iterable[str] = ()) -> Column:
    """Exact membership in the custom list first, then ordered prefixes, then `macro`, else `other`."""
    custom, macros = list(custom), list(macros)
    rest = F.when(symbol.isin(macros), "macro").otherwise("other") if macros else F.lit("other")
    out = F.coalesce(first_fit(symbol, [(p, name) for name, prefixes in rules.items() for p in prefixes]), rest)
    return F.when(symbol.isin(custom), CUSTOM).otherwise(out) if custom else out


def tier_of(category: Column) -> Column:
    return F.when(category.isin(TIER_1), 1).when(category.isin(TIER_3), 3).otherwise(2)


def sql_category(symbol: str, rules: Mapping[str, list[str]] = PREFIXES) -> str:
    """The same rules as a SQL expression."""
    cases = " ".join(f"WHEN {' OR '.join(f'starts_with({symbol}, {p!r})' for p in prefixes)} THEN '{name}'" for name, prefixes in rules.items())
    return f"CASE {cases} ELSE 'other' END"
