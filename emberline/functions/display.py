"""Columns shown to an operator on the monitoring board."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .levels import first_keyword

# --- Fixed values: texts and patterns an existing reader of the board expects. ---
DEFAULT_ALERT_RATIO = 2.0
MESSAGE_WIDTH = 240
COMPACT_MESSAGE_WIDTH = 180
ANOMALY, NORMAL = "ANOMALIE", "NORMAL"
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER_PATTERN = r"user=([a-zA-Z0-9_.-]+)"
NO_IP, NO_USER = "non détectée", "non détecté"
ADVICE_ACCESS = (
    "Vérifier les authentifications récentes, identifier l'IP source et bloquer l'accès si nécessaire."
)
ADVICE_NETWORK = "Vérifier la connectivité réseau, la disponibilité du service et les timeouts applicatifs."
ADVICE_SERVICE = (
    "Inspecter le service concerné, corréler avec les logs voisins et redémarrer si l'erreur se répète."
)
ADVICE_DEFAULT = "Analyser le service concerné, corréler avec les logs voisins et vérifier l'état de l'hôte."
ADVICE_RULES = [
    ("authentication", ADVICE_ACCESS), ("ssh", ADVICE_ACCESS), ("kerberos", ADVICE_ACCESS),
    ("timeout", ADVICE_NETWORK), ("connection", ADVICE_NETWORK),
    ("error", ADVICE_SERVICE), ("failed", ADVICE_SERVICE),
]
ANOMALY_ANALYSIS = (
    "Le modèle classe ce log comme anomalie car son ratio de sévérité (%s) dépasse le seuil configuré (%sx). "
    "Le service %s sur l'hôte %s présente un comportement inhabituel par rapport au profil appris."
)
ANOMALY_ACTION = (
    "Action recommandée : inspecter le service, corréler avec les logs voisins, vérifier les accès récents et "
    "redémarrer le pod si l'erreur se répète."
)
NORMAL_ANALYSIS = (
    "Le log est considéré comme normal : le ratio %s reste sous le seuil critique. Le score IA peut paraître "
    "élevé, mais la décision repose sur le ratio normalisé."
)
NORMAL_ACTION = (
    "Aucune action immédiate. Continuer la surveillance et conserver le log pour analyse historique."
)
COMPACT_ANOMALY_ANALYSIS = (
    "Ce log présente un comportement anormal détecté par le modèle IA. Le ratio de sévérité est de %s, ce qui "
    "dépasse le seuil configuré à %s. La source concernée est %s sur l’hôte %s."
)
COMPACT_ANOMALY_ACTION = (
    "Analyser le service concerné, vérifier les erreurs récentes, corréler avec les autres logs et envisager une "
    "action de remédiation comme un redémarrage du pod ou une inspection Kubernetes."
)
COMPACT_NORMAL_ANALYSIS = (
    "Ce log est considéré comme normal. Son ratio de sévérité est de %s, donc inférieur au seuil critique."
)
COMPACT_NORMAL_ACTION = "Aucune action immédiate n’est nécessaire. Continuer la surveillance."
MAIL_LINES = [
    ("Timestamp : ", "timestamp"), ("Source    : ", "source"), ("Host      : ", "host"),
    ("Statut    : ", "status"), ("Score IA  : ", "score_text"), ("Ratio     : ", "ratio_text"),
    ("Modèle    : ", "model"),
]
# --- End of fixed values. ---


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def clock(iso_text: Column) -> Column:
    """First 19 characters of an ISO time, with a blank for the ``T``."""
    return F.replace(F.substring(F.coalesce(iso_text, F.lit("")), 1, 19), F.lit("T"), F.lit(" "))


def status(ratio: Column, alert_ratio: float = DEFAULT_ALERT_RATIO) -> Column:
    return F.when(ratio > F.lit(alert_ratio), F.lit(ANOMALY)).otherwise(F.lit(NORMAL))


def first_ip(message: Column) -> Column:
    found = F.regexp_extract(message, IP_PATTERN, 0)
    return F.when(found == "", F.lit(NO_IP)).otherwise(found)


def first_user(message: Column) -> Column:
    found = F.regexp_extract(message, USER_PATTERN, 1)
    return F.when(found == "", F.lit(NO_USER)).otherwise(found)


def recommendation(message: Column) -> Column:
    return first_keyword(message, ADVICE_RULES, ADVICE_DEFAULT)


def analysis(state: Column, ratio_text: Column, source: Column, host: Column,
             alert_ratio: float = DEFAULT_ALERT_RATIO, compact: bool = False) -> Column:
    limit = F.lit(f"{alert_ratio:.1f}")
    high, low = (COMPACT_ANOMALY_ANALYSIS, COMPACT_NORMAL_ANALYSIS) if compact else (ANOMALY_ANALYSIS, NORMAL_ANALYSIS)
    return F.when(state == ANOMALY, F.format_string(high, ratio_text, limit, source, host)).otherwise(
        F.format_string(low, ratio_text)
    )


def action(state: Column, compact: bool = False) -> Column:
    high, low = (COMPACT_ANOMALY_ACTION, COMPACT_NORMAL_ACTION) if compact else (ANOMALY_ACTION, NORMAL_ACTION)
    return F.when(state == ANOMALY, F.lit(high)).otherwise(F.lit(low))
