"""Catalogs and closed lists used by the operators.

Everything under "Fixed values" must equal the tool whose results we match, so
it is stated plainly.  Each catalog is tiny and constant (well under 200 rows):
operators either fold it into a regular expression at plan-building time or
broadcast it, and neither grows with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "javascript",
    "tsx": "javascript",
    "c": "c",
    "h": "c",
    "i": "c",
}

HIGH_RISK_PATTERNS = {
    "sql_injection": [
        r"SELECT.*\+.*",
        r"INSERT.*\+.*",
        r"UPDATE.*\+.*",
        r"DELETE.*\+.*",
        r"execute\([^)]*\+",
        r"query\([^)]*\+",
        r"`SELECT.*\$\{.*\}`",
        r"`INSERT.*\$\{.*\}`",
    ],
    "xss": [
        r"render_template_string\(",
        r"innerHTML\s*=",
        r"document\.write\(",
        r"eval\(",
        r"dangerouslySetInnerHTML",
        r"v-html\s*=",
    ],
    "file_traversal": [
        r"open\([^)]*\+",
        r"file\([^)]*\+",
        r"Path\([^)]*\+",
        r"os\.path\.join\([^)]*\+.*\.\.",
        r"fs\.readFile\([^)]*\+",
        r"require\([^)]*\+",
    ],
    "auth_bypass": [
        r"if.*password.*==.*[\"'][\"']",
        r"if.*token.*==.*None",
        r"bypass.*auth",
        r"if\s*\(\s*!.*auth",
    ],
}

RISK_KEYWORDS = {
    "database": ["execute", "query", "cursor", "fetchall", "fetchone", "find", "findOne"],
    "file_ops": ["open", "read", "write", "Path", "glob", "readFile", "writeFile"],
    "user_input": ["input", "request", "args", "form", "json", "params", "body"],
    "auth": ["login", "authenticate", "verify", "check_password", "jwt", "token"],
    "dangerous": ["eval", "exec", "compile", "subprocess", "Function", "setTimeout"],
}

DANGEROUS_C_FUNCTIONS = {
    "buffer_overflow": ["strcpy", "strcat", "sprintf", "gets", "scanf"],
    "format_string": ["printf", "fprintf", "sprintf", "snprintf"],
    "memory_management": ["malloc", "free", "realloc", "calloc"],
    "file_operations": ["fopen", "fread", "fwrite", "fgets", "pread", "pwrite", "mmap", "munmap"],
    "system_calls": ["system", "exec", "popen"],
    "crypto_operations": [
        "RSA_private_decrypt", "RSA_public_encrypt", "RSA_sign", "RSA_verify",
        "EVP_DecryptUpdate", "EVP_DecryptFinal_ex", "EVP_EncryptUpdate", "EVP_EncryptFinal_ex",
        "PEM_read_RSAPrivateKey", "PEM_read_bio_RSAPrivateKey", "PEM_write_RSAPrivateKey",
        "OPENSSL_malloc", "OPENSSL_free", "OPENSSL_cleanse", "OPENSSL_clear_free",
    ],
    "asn1_parsing": [
        "parse_asn1_length", "d2i_RSAPrivateKey", "i2d_RSAPrivateKey", "ASN1_STRING_get0_data",
        "d2i_X509", "i2d_X509", "ASN1_INTEGER_get", "ASN1_STRING_length",
    ],
    "file_descriptor_ops": ["ftruncate", "mkstemp", "open", "close", "lseek"],
    "crypto_error_handling": ["ERR_get_error", "ERR_print_errors_fp", "ERR_clear_error"],
}

CRYPTO_FOCUS_FUNCTIONS = {
    "crypto_operations": [
        "RSA_private_decrypt", "RSA_public_encrypt",
        "EVP_DecryptUpdate", "EVP_DecryptFinal_ex",
        "EVP_EncryptUpdate", "EVP_EncryptFinal_ex",
        "PEM_read_RSAPrivateKey", "PEM_read_bio_RSAPrivateKey",
        "OPENSSL_malloc", "OPENSSL_free", "OPENSSL_cleanse",
    ],
    "file_operations": ["pread", "pwrite", "ftruncate", "mkstemp", "mmap", "munmap"],
    "asn1_parsing": ["parse_asn1_length", "d2i_", "i2d_", "ASN1_"],
    "error_handling": ["ERR_get_error", "ERR_print_errors_fp", "ERR_clear_error"],
}
# These catalog entries are name prefixes, the rest are whole names.
PREFIX_FUNCTIONS = ["d2i_", "i2d_", "ASN1_"]

CRYPTO_INDICATORS = {
    "cryptographic_operations": [
        "rsa_private_decrypt", "evp_decrypt", "pem_read", "openssl_", "asn1_",
    ],
    "key_handling": ["private_key", "aes_key", "rsa", "key", "decrypt", "encrypt"],
    "file_operations": ["pread", "pwrite", "ftruncate", "mmap", "mkstemp"],
}

USER_INPUT_PARAMS = {
    "python": ["request", "input", "user", "data", "payload", "query", "form"],
    "javascript": ["req", "request", "input", "data", "body", "query", "params"],
    "c": [
        "input", "data", "buffer", "buf", "str", "string",
        "argv", "argc", "cmd", "command", "file", "path",
    ],
}

DANGEROUS_PY_NAMES = [
    "eval", "exec", "compile", "__import__",
    "open", "file", "input", "raw_input",
    "subprocess", "os.system", "os.popen",
]

WEB_DECORATORS = ["route", "post", "get", "put", "delete", "api"]

# Ordered: the first category whose term occurs in the call name wins.
PY_CALL_CATEGORIES = {
    "sql_queries": ["execute", "query", "cursor", "fetchall"],
    "file_operations": ["open", "read", "write", "file"],
    "network_calls": ["request", "urlopen", "socket", "connect"],
    "crypto_operations": ["encrypt", "decrypt", "hash", "md5", "sha"],
    "input_operations": ["input", "raw_input", "getpass"],
}

# Ordered: the first pattern found in the lower-cased code wins.
FALLBACK_RULES = [
    (r"execute\([^)]*\+.*[\"']", 0.8, "sql_injection", "String concatenation in execute() call"),
    (r"f\".*select.*\{.*user.*\}", 0.9, "sql_injection", "F-string with user input in SQL query"),
    (r"eval\(.*user", 0.9, "code_injection", "eval() with user input"),
    (r"exec\(.*user", 0.9, "code_injection", "exec() with user input"),
    (r"os\.system\([^)]*\+", 0.8, "command_injection", "Command injection via os.system"),
    (r"subprocess.*shell=true.*\+", 0.8, "command_injection", "Command injection in subprocess"),
]
FALLBACK_SUFFIX = " (pattern-based detection)"
FALLBACK_SEVERITY = "high"
FALLBACK_REMEDIATION = "Review and sanitize user input"
FALLBACK_CLEAN = "No clear vulnerability patterns detected in fallback analysis"

BUFFER_OVERFLOW_PATTERNS = [
    r"strcpy\s*\(", r"strcat\s*\(", r"sprintf\s*\(", r"gets\s*\(", r"scanf\s*\([^)]*%s",
]
FORMAT_STRING_PATTERNS = [
    r"printf\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\)",
    r"fprintf\s*\([^,]*,\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\)",
]
NULL_POINTER_PATTERN = r"\*\s*[a-zA-Z_][a-zA-Z0-9_]*\s*(?!==|!=)"

VULN_TYPES = {
    "c": [
        "buffer_overflow", "format_string", "memory_management", "integer_issue",
        "injection_command", "path_traversal", "crypto_weakness", "auth_logic",
        "network_parsing", "other",
    ],
    "javascript": [
        "xss", "code_injection", "prototype_pollution", "command_injection",
        "sql_injection", "path_traversal", "ssrf", "auth_logic", "insecure_crypto", "other",
    ],
    "python": [
        "code_injection", "sql_injection", "command_injection", "deserialization",
        "path_traversal", "ssrf", "template_injection", "auth_logic", "crypto_weakness", "other",
    ],
}

SEVERITIES = ["info", "low", "medium", "high", "critical"]

# Lower bound of each confidence band, highest first.
CONFIDENCE_BANDS = [
    (0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low"), (0.0, "very_low"),
]

RISK_NUMBER = r"\b(?:0\.\d+|1\.0|0|1)\b"
# Ordered: the first group with a word in the answer gives the score.
RISK_WORDS = [
    (["high", "critical", "dangerous"], 0.8),
    (["medium", "moderate"], 0.5),
    (["low", "minimal", "safe"], 0.2),
]
DEFAULT_RISK = 0.5
ANALYSE_AT = 0.5
MEDIUM_ABOVE = 0.3
ACCEPT_ABOVE = 0.5
CODE_LIMIT_FOR_SCORING = 2000
SNIPPET_LIMIT = 200
FALLBACK_SNIPPET_LIMIT = 100

C_DIRECTIVES = ["include", "define", "pragma", "ifndef", "ifdef", "endif", "else"]

GCC_WORDS = [
    "packed", "used", "unused", "deprecated", "weak", "always_inline", "noinline",
    "pure", "const", "noreturn", "malloc", "must_check", "wur", "restrict",
    "volatile", "inline", "forceinline",
]
GCC_CALLS = ["aligned", "section", "alias", "printf", "scanf", "format_arg", "nonnull"]

HINT_HEADERS = ["stdio.h", "stdlib.h", "string.h", "openssl/"]

COMPILER_FAMILIES = {
    "cc": "gcc",
    "gcc": "gcc",
    "clang": "clang",
    "g++": "g++",
    "clang++": "clang++",
}
DEFAULT_COMPILER = "gcc"

SECRET_PATTERN = (
    r"(?i)(password|token|secret|api_key)\s*=+\s*[\"'][^\"']+[\"']"
)

# --------------------------------------------------------------------------
# Derived forms
# --------------------------------------------------------------------------


def any_of(words: list[str], lower: bool = True) -> str:
    """One alternation matching any of ``words`` literally."""
    return "|".join(re.escape(w.lower() if lower else w) for w in words)


def rule_rows() -> list[tuple[str, str, str]]:
    """(rule_id, vuln_type, regex) for the declared pattern catalog."""
    return [
        (f"{vuln_type}_{i}", vuln_type, regex)
        for vuln_type, regexes in HIGH_RISK_PATTERNS.items()
        for i, regex in enumerate(regexes, 1)
    ]


def dangerous_function_rows(crypto_focus: bool = False) -> list[tuple[str, str, str]]:
    """(category, function, match_kind), merged with the crypto entries on request."""
    catalogs = [DANGEROUS_C_FUNCTIONS] + ([CRYPTO_FOCUS_FUNCTIONS] if crypto_focus else [])
    rows = {
        (category, function, "prefix" if function in PREFIX_FUNCTIONS else "exact")
        for catalog in catalogs
        for category, functions in catalog.items()
        for function in functions
    }
    return sorted(rows)


def dangerous_functions(spark: SparkSession, crypto_focus: bool = False) -> DataFrame:
    return spark.createDataFrame(
        dangerous_function_rows(crypto_focus), "category string, function string, match_kind string"
    )


def vuln_types(spark: SparkSession) -> DataFrame:
    rows = [(lang, t) for lang, types in VULN_TYPES.items() for t in types]
    return spark.createDataFrame(rows, "lang string, vulnerability_type string")


def severity_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, i) for i, s in enumerate(SEVERITIES, 1)], "severity string, severity_rank int"
    )


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "ext string, lang string")


def compiler_families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(COMPILER_FAMILIES.items()), "compiler string, family string"
    )
