"""Column functions that take secrets out of texts and URLs."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import EDGE, text

# --- fixed values: names that mark a secret -------------------------------------------------------
SECRET_QUERY_KEYS = (
    "token", "access_token", "id_token", "refresh_token", "auth", "auth_token", "authorization", "sig", "signature", "jwt",
    "password", "passwd", "pwd", "secret", "client_secret", "apikey", "api_key", "key", "code", "access_key", "otp", "hmac",
    "credential", "credentials", "security_token", "sessionid", "session_id", "session_token", "awsaccesskeyid", "googleaccessid",
    "x_goog_signature", "x_goog_credential", "x_goog_signedheaders",
)
SECRET_KEYS = (
    "apikey", "apisecret", "clientsecret", "cloudapikey", "secret", "secretkey", "accesstoken", "refreshtoken", "idtoken",
    "bearer", "password", "authorization", "privatekey", "subscriptionkey", "xapikey",
)
TOKEN_PARENTS = ("auth", "authorization", "credential", "credentials", "header", "headers", "oauth", "secret", "secrets", "session")
# --------------------------------------------------------------------------------------------------


def redact(c) -> Column:
    """Masks user info of URLs, keys, bearer values, one vendor's header and key parameters, in that order."""
    t = F.regexp_replace(text(c), r"//[^/\s@]*:[^/\s@]+@", "//***:***@")
    t = F.regexp_replace(t, r"sk-[A-Za-z0-9_-]+", "***")
    t = F.regexp_replace(t, rf"(?i){EDGE}Bearer\s+\S+", "Bearer ***")
    t = F.regexp_replace(t, rf"(?i){EDGE}DeepL-Auth-Key\s+\S+", "DeepL-Auth-Key ***")
    keys = r"(?i)([?&#](?:x[-_]?api[-_]?key|api[-_]?key|access[-_]?(?:token|key)|token|secret|key)=)[^&\s#]+"
    return F.regexp_replace(t, keys, "$1***")


def redact_strict(c) -> Column:
    """Also masks every run of twenty key characters or more, ordinary long words included."""
    t = F.regexp_replace(text(c), r"sk-[A-Za-z0-9_-]+", "***")
    t = F.regexp_replace(t, r"(?i)Bearer\s+\S+", "***")
    return F.regexp_replace(t, r"[A-Za-z0-9_-]{20,}", "***")


def secret_name(c) -> Column:
    return F.regexp_replace(F.lower(text(c)), r"[-_\s]", "")


def is_secret_key(key, parent) -> Column:
    """A field's name marks a secret; ``token`` only below a parent that holds credentials."""
    return secret_name(key).isin(*SECRET_KEYS) | ((secret_name(key) == "token") & secret_name(parent).isin(*TOKEN_PARENTS))


def _secret_parameter(name: Column) -> Column:
    own = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return own.isin(*SECRET_QUERY_KEYS) | own.startswith("x_amz_")


def scrub_url(c) -> Column:
    """An http(s) URL without user info, fragment and secret parameters of query, matrix and path; empty for others.

    Percent-coded names of parameters are not decoded.
    """
    t = F.trim(text(c))
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(t, r"^[^:]*://|#.*$", "")
    authority = F.regexp_extract(rest, r"^[^/?]*", 0)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    name = lambda p: F.substring_index(p, "=", 1)

    def segment(s: Column) -> Column:
        pieces = F.split(s, ";", -1)
        head = F.element_at(pieces, 1)
        kept = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: ~_secret_parameter(name(p)))
        own = F.array_join(F.concat(F.array(head), kept), ";")
        return F.when(~(head.contains("=") & _secret_parameter(name(head))), own)

    segments = F.filter(F.transform(F.split(path, "/", -1), segment), lambda s: s.isNotNull())
    clean_path = F.regexp_replace(F.array_join(segments, "/"), "/{2,}", "/")
    clean_path = F.when(clean_path.startswith("/"), clean_path).otherwise(F.concat(F.lit("/"), clean_path))
    kept = F.filter(F.split(query, "&", -1), lambda p: ~_secret_parameter(name(p)))
    clean_query = F.regexp_replace(F.array_join(kept, "&"), "^&+|&+$", "")
    out = F.concat(scheme, F.lit("://"), host, clean_path, F.when(clean_query != "", F.concat(F.lit("?"), clean_query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), out).otherwise("")


def scrub_event_url(c) -> Column:
    """As ``scrub_url``; of other schemes only the scheme stays."""
    scheme = F.lower(F.regexp_extract(F.trim(text(c)), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    own = scrub_url(c)
    return F.when(own != "", own).when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")


def scrub_message(c, secrets: list[str] = (), limit: int = 2048, keep: int = 300) -> Column:
    """A message cut to ``limit``, URLs scrubbed to their host, secrets and keys masked, then cut to ``keep``."""
    t = F.substring(text(c), 1, limit)
    t = F.regexp_replace(t, r"(?i)\b(https?)://(?:[^/\s@]*@)?([^/\s?#<>\"']+)[^\s<>\"']*", "$1://$2")
    for s in sorted({s.strip() for s in secrets if len(s.strip()) >= 6}, key=len, reverse=True):
        t = F.replace(t, F.lit(s), F.lit("***"))
    return F.substring(redact(t), 1, keep)


def _walk(value, found, key="", below=False):
    below = below or key == "secrets"
    if isinstance(value, dict):
        for k, v in value.items():
            _walk(v, found, k, below)
    elif isinstance(value, list):
        for v in value:
            _walk(v, found, key, below)
    elif value is not None:
        name = "".join(c for c in key.lower() if c not in "-_ ")
        if (name in SECRET_KEYS or below and isinstance(value, str)) and len(str(value).strip()) >= 6:
            found.add(str(value).strip())


@F.pandas_udf(T.ArrayType(T.StringType()))
def secret_values(s):
    """Values of secret fields at any depth of a JSON text, of six characters or more."""

    def one(x):
        found = set()
        try:
            _walk(json.loads(x), found)
        except (TypeError, ValueError):
            pass
        return sorted(found)

    return s.map(one)


def _strip(value, parent=""):
    if isinstance(value, list):
        return [_strip(v, parent) for v in value]
    if not isinstance(value, dict):
        return value
    fold = lambda k: "".join(c for c in k.lower() if c not in "-_ ")
    secret = lambda k: fold(k) in SECRET_KEYS or fold(k) == "token" and fold(parent) in TOKEN_PARENTS
    return {k: _strip(v, k) for k, v in value.items() if not secret(k)}


@F.pandas_udf(T.StringType())
def strip_secrets(s):
    """A JSON text without its secret fields; text that is no JSON becomes null."""

    def one(x):
        try:
            return json.dumps(_strip(json.loads(x)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return s.map(one)
