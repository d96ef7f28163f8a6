"""Word lists and patterns that decide results."""

# A column whose lower-cased name contains one of these is sensitive.
SENSITIVE_NAME_PARTS = (
    "cpf", "cnpj", "ssn", "email", "e-mail", "phone", "telefone", "celular", "nome", "name",
    "address", "endereco", "senha", "password", "token", "secret", "api_key", "cartao",
    "credit_card",
)

# Column names that are taken for a modelling target when equal.
STRONG_TARGET_NAMES = (
    "target", "label", "classe", "class", "resultado", "result", "churn", "fraude", "fraud",
    "aprovado", "inadimplente", "default",
)

# The names above plus the weaker hint, also searched inside names.
TARGET_HINTS = STRONG_TARGET_NAMES + ("status",)

# Parts of a column name that announce dates.
DATE_NAME_PARTS = ("date", "data", "dt_", "_dt", "created", "updated")

# Tokens read as truth values; the last two only when typing a column.
TRUTH_TOKENS = ("true", "false", "yes", "no", "sim", "nao", "não", "0", "1")
TRUTH_LETTERS = ("y", "n")

# A key containing one of these has its value masked.
SECRET_KEY_PARTS = (
    "api_key", "apikey", "token", "secret", "password", "passwd", "authorization", "auth",
    "credential", "bearer",
)

# Words that make a SQL text unacceptable as a source.
MUTATING_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "merge", "grant",
    "revoke", "call", "execute", "attach", "detach", "pragma",
)

# What a stated objective mentions.
OBJECTIVE_LANGUAGE = ("pergunta", "linguagem natural", "chat", "consulta", "sql", "dashboard")
OBJECTIVE_PREDICTION = ("prever", "predizer", "classificar", "regressao", "regression", "forecast")
OBJECTIVE_RISK = ("fraude", "risco", "inadimpl", "churn")

# Places searched for records in a JSON document, in this order.
RECORD_PATHS = ("data", "items", "results", "response.items", "response.data")

# Separators tried on delimited text; earlier ones win ties.
SEPARATORS = (",", ";", "\t", "|")
