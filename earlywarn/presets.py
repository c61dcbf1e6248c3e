"""Fixed values of the student-record preset.

Everything here is data, not logic: the operators take these as arguments and work on any schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --------------------------------------------------------------------------------------------
# Column names, their order, status words, tokens and thresholds that results
# depend on.
# --------------------------------------------------------------------------------------------

ENEM_GRADES = [
    "nota_enem_humanas",
    "nota_enem_linguagem",
    "nota_enem_matematica",
    "nota_enem_natureza",
    "nota_enem_redacao",
]

VESTIBULAR_GRADES = [
    "nota_vestibular_biologia",
    "nota_vestibular_filosofia_sociologia",
    "nota_vestibular_fisica",
    "nota_vestibular_geografia",
    "nota_vestibular_historia",
    "nota_vestibular_literatura_brasileira",
    "nota_vestibular_lingua_estrangeira",
    "nota_vestibular_lingua_portuguesa",
    "nota_vestibular_matematica",
    "nota_vestibular_quimica",
]

CATEGORICAL_FEATURES = [
    "sexo",
    "municipio_residencia",
    "curso",
    "campus",
    "turno",
    "modalidade_ingresso",
    "tipo_cota",
]

NUMERIC_FEATURES = [
    "coeficiente_rendimento",
    "disciplinas_aprovadas",
    "disciplinas_reprovadas_nota",
    "periodo",
    "ano_ingresso",
    "semestre_ingresso",
    *ENEM_GRADES,
    *VESTIBULAR_GRADES,
    "idade",
    "calouro",
]

ENGINEERED_FEATURES = ["aprovacao_ratio", "nota_enem_total", "nota_vestibular_total"]

FEATURE_COLUMNS = [
    *CATEGORICAL_FEATURES,
    "coeficiente_rendimento",
    "disciplinas_aprovadas",
    "disciplinas_reprovadas_nota",
    "periodo",
    "ano_ingresso",
    "semestre_ingresso",
    *ENEM_GRADES,
    *VESTIBULAR_GRADES,
    "calouro",
    "idade",
]

_SHARED_FIELDS = [
    "sexo",
    "municipio_residencia",
    "data_nascimento",
    "idade",
    "curso",
    "campus",
    "turno",
    "modalidade_ingresso",
    "tipo_cota",
    "situacao",
    "coeficiente_rendimento",
    "disciplinas_aprovadas",
    "disciplinas_reprovadas_nota",
    "total_semestres_cursados",
    "periodo",
    "ano_ingresso",
    "semestre_ingresso",
    *ENEM_GRADES,
    *VESTIBULAR_GRADES,
    "calouro",
]

SCORING_FIELDS = [*_SHARED_FIELDS, "nome_aluno", "codigo_aluno"]
TRAINING_FIELDS = [*_SHARED_FIELDS, "codigo_aluno", "ano_referencia", "periodo_referencia"]

DECIMAL_COLUMNS = [
    "coeficiente_rendimento",
    "disciplinas_aprovadas",
    "disciplinas_reprovadas_nota",
    "total_semestres_cursados",
    "ano_ingresso",
    "semestre_ingresso",
    "idade",
    "calouro",
]

UPPER_COLUMNS = [
    "sexo",
    "turno",
    "curso",
    "campus",
    "modalidade_ingresso",
    "tipo_cota",
    "municipio_residencia",
]

ID_COLUMNS = ["nome_aluno", "codigo_aluno"]

TECHNICAL_COLUMNS = [
    "codigo_aluno",
    "ano_referencia",
    "periodo_referencia",
    "situacao",
    "target_evasao",
    "is_target_valid",
]

REQUIRED_COLUMNS = [
    "sexo",
    "cor_raca",
    "municipio_residencia",
    "uf_residencia",
    "data_nascimento",
    "curso",
    "campus",
    "turno",
    "modalidade_ingresso",
    "tipo_cota",
    "coeficiente_rendimento",
    "disciplinas_aprovadas",
    "disciplinas_reprovadas_nota",
    "disciplinas_reprovadas_frequencia",
    "periodo",
    "ano_ingresso",
    "semestre_ingresso",
    *ENEM_GRADES,
    *VESTIBULAR_GRADES,
    "idade",
    "situacao",
]
CRITICAL_COLUMNS = ["situacao"]

DROPOUT_STATUSES = ["desistente", "trancado"]
COMPLETED_STATUSES = ["formado"]
NEGATIVE_STATUSES = ["formado", "concluido"]
POSITIVE_STATUSES = ["desistente", "trancado", "evadido"]
ACTIVE_STATUS = "regular"

PLACEHOLDER_TOKENS = ["na", "n/a", "-", ""]
# The tokens a pandas CSV reader maps to missing at scan time.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOLEAN_TOKENS = {"sim": 1.0, "não": 0.0, "nao": 0.0}

ENEM_ROUTE = "enem|sisu"
VESTIBULAR_ROUTE = "vestibular"

RISK_LABELS = ("Baixo", "Médio", "Alto")
LOW_RISK_CUT = 0.33
DEFAULT_RISK_THRESHOLD = 0.4
HIGH_RISK_CUT = 0.66
DISPLAY_FIRST = ["nome_aluno", "codigo_aluno", "risk_label", "risk_pct", "prob_evasao", "situacao"]

HEADER_HINTS = {
    "coeficiente_rendimento": ["cr", "coeficiente", "rendimento", "ira"],
    "municipio_residencia": ["municipio"],
}
FUZZY_THRESHOLD = 80.0

# Normalised source header -> canonical field; None marks a header known to have no field.
HEADER_ALIASES = {
    "genero": "sexo",
    "sexo": "sexo",
    "idade": "idade",
    "data de nascimento": "data_nascimento",
    "municipio": "municipio_residencia",
    "curso": "curso",
    "nome do curso": "curso",
    "curso graduacao": "curso",
    "campus": "campus",
    "turno": "turno",
    "forma de ingresso": "modalidade_ingresso",
    "modalidade de ingresso": "modalidade_ingresso",
    "tipo de cota": "tipo_cota",
    "cota": "tipo_cota",
    "situacao": "situacao",
    "situacao atual": "situacao",
    "status": "situacao",
    "status do aluno": "situacao",
    "periodo": "periodo",
    "serie": "periodo",
    "semestre atual": "periodo",
    "ano de ingresso": "ano_ingresso",
    "ano ingresso": "ano_ingresso",
    "semestre de ingresso no curso": "semestre_ingresso",
    "semestre de ingresso": "semestre_ingresso",
    "semestre ingresso": "semestre_ingresso",
    "total de semestres cursados": "total_semestres_cursados",
    "disciplinas aprovadas": "disciplinas_aprovadas",
    "disciplinas reprovadas por nota": "disciplinas_reprovadas_nota",
    "nr disciplinas aprovadas": "disciplinas_aprovadas",
    "nr disciplinas reprovadas por nota": "disciplinas_reprovadas_nota",
    "provavel jubilamento": None,
    "retencao parcial": None,
    "retencao total": None,
    "calouro": "calouro",
    "coeficiente de rendimento absoluto": "coeficiente_rendimento",
    "disciplinas reprovadas por frequencia": None,
    "nr disciplinas reprovadas por frequencia": None,
    "cor ou raca": None,
    "raca": None,
    "uf": None,
    "estado": None,
    "nota enem humanas": "nota_enem_humanas",
    "nota enem linguagem": "nota_enem_linguagem",
    "nota enem liguagem": "nota_enem_linguagem",
    "nota enem matematica": "nota_enem_matematica",
    "nota enem natureza": "nota_enem_natureza",
    "nota enem redacao": "nota_enem_redacao",
    "nota vestibular biologia": "nota_vestibular_biologia",
    "nota vestibular filosofia e sociologia": "nota_vestibular_filosofia_sociologia",
    "nota vestibular fisica": "nota_vestibular_fisica",
    "nota vestibular geografia": "nota_vestibular_geografia",
    "nota vestibular historia": "nota_vestibular_historia",
    "nota vestibular literatura brasileira": "nota_vestibular_literatura_brasileira",
    "nota vestibular lingua estrangeira moderna (espanhol ou ingles)": "nota_vestibular_lingua_estrangeira",
    "nota vestibular lingua portuguesa": "nota_vestibular_lingua_portuguesa",
    "nota vestibular matematica": "nota_vestibular_matematica",
    "nota vestibular quimica": "nota_vestibular_quimica",
    "nome": "nome_aluno",
    "nome do aluno": "nome_aluno",
    "aluno": "nome_aluno",
    "codigo": "codigo_aluno",
    "matricula": "codigo_aluno",
    "ra": "codigo_aluno",
}

# Declared types of the canonical fields; every field that is not listed is text.
DATE_FIELDS = ["data_nascimento"]
INTEGER_FIELDS = [
    "idade",
    "disciplinas_aprovadas",
    "disciplinas_reprovadas_nota",
    "total_semestres_cursados",
    "periodo",
    "ano_ingresso",
    "semestre_ingresso",
    "calouro",
    "ano_referencia",
    "periodo_referencia",
]
DECIMAL_FIELDS = ["coeficiente_rendimento", *ENEM_GRADES, *VESTIBULAR_GRADES]

# The short record form accepted one by one: name and type.
SHORT_RECORD = [
    ("id_aluno", T.LongType()),
    ("nome", T.StringType()),
    ("data_nascimento", T.DateType()),
    ("sexo", T.StringType()),
    ("escola", T.StringType()),
    ("serie", T.StringType()),
    ("turno", T.StringType()),
    ("ano_letivo", T.LongType()),
    ("situacao", T.StringType()),
]

# ------------------------------------------------------------------------------ end of fixed values


def canonical_schema(fields: list[str]) -> T.StructType:
    """Declared schema of the canonical fields, all nullable."""

    def kind(name: str) -> T.DataType:
        if name in DATE_FIELDS:
            return T.DateType()
        if name in INTEGER_FIELDS:
            return T.LongType()
        return T.DoubleType() if name in DECIMAL_FIELDS else T.StringType()

    return T.StructType([T.StructField(f, kind(f)) for f in fields])


def short_record_schema() -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in SHORT_RECORD])


@dataclass(frozen=True)
class RouteRule:
    """Rows whose route matches ``pattern`` get ``blank`` columns set to NULL."""

    pattern: str
    blank: tuple[str, ...]


@dataclass(frozen=True)
class RecordPreset:
    """What the cleaning plan needs to know about one kind of record."""

    fields: tuple[str, ...]
    features: tuple[str, ...]
    status: str
    decimals: tuple[str, ...]
    uppers: tuple[str, ...]
    grade_prefix: str = "nota_"
    birth_date: str | None = "data_nascimento"
    age: str | None = "idade"
    route: str | None = "modalidade_ingresso"
    route_rules: tuple[RouteRule, ...] = field(default_factory=tuple)
    ids: tuple[str, ...] = ()
    label_keys: tuple[str, ...] = ()


_ROUTES = (
    RouteRule(VESTIBULAR_ROUTE, tuple(ENEM_GRADES)),
    RouteRule(ENEM_ROUTE, tuple(VESTIBULAR_GRADES)),
)

SCORING_PRESET = RecordPreset(
    fields=tuple(SCORING_FIELDS),
    features=tuple(FEATURE_COLUMNS),
    status="situacao",
    decimals=tuple(DECIMAL_COLUMNS),
    uppers=tuple(UPPER_COLUMNS + ID_COLUMNS),
    route_rules=_ROUTES,
    ids=tuple(ID_COLUMNS),
)

TRAINING_PRESET = RecordPreset(
    fields=tuple(TRAINING_FIELDS),
    features=tuple(FEATURE_COLUMNS),
    status="situacao",
    decimals=tuple(DECIMAL_COLUMNS),
    uppers=tuple(UPPER_COLUMNS),
    route_rules=_ROUTES,
    label_keys=("codigo_aluno", "ano_referencia", "periodo_referencia"),
)
