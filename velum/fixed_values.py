"""What must be equal for equal results. Types and labels, word lists, hints, formats and limits, in their own order."""

from __future__ import annotations

# Entity types with their display names and tag labels.
TYPES = (
    ("rfc", "RFC", "RFC"),
    ("curp", "CURP", "CURP"),
    ("clabe", "CLABE", "CLABE"),
    ("cedula", "Cédula profesional", "CEDULA"),
    ("phone", "Teléfono", "TELEFONO"),
    ("email", "Correo", "CORREO"),
    ("name", "Nombre", "NOMBRE"),
    ("organization", "Empresa", "EMPRESA"),
    ("address", "Domicilio", "DOMICILIO"),
    ("identifier", "Identificador", "IDENTIFICADOR"),
)

# Word lists of the candidate filter.
STOPWORDS = (
    "de", "del", "la", "el", "los", "las", "y", "e", "o", "u", "en", "por", "con", "para", "un", "una", "unos", "unas", "al", "lo",
    "le", "se", "su", "sus", "es", "son", "hay", "que", "como", "si", "no", "mas", "más", "a", "the", "of", "and",
)
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "setiembre", "octubre", "noviembre",
    "diciembre",
)
LEGAL_TERMS = (
    "iva", "liva", "isr", "lisr", "ieps", "isn", "mxn", "mn", "m.n.", "pesos", "peso", "art", "artículo", "articulo", "fracción",
    "fraccion", "inciso", "párrafo", "parrafo",
)
COMMON_NOUNS = (
    "trabajo", "papeles", "memorándum", "memorandum", "fecha", "periodo", "período", "evaluación", "evaluacion", "antecedentes",
    "operación", "operacion", "resumen", "ingresos", "gastos", "concepto", "monto", "proveedor", "proveedores", "honorarios", "renta",
    "multa", "observaciones", "auditor", "firma", "supervisor", "negocio", "departamento", "facturación", "contabilidad",
    "inventario", "requisito", "tasa", "impuesto", "actos", "pago", "revisión", "revision", "determinación", "determinacion",
    "dictamen", "fiscal",
)

# What else the filter knows.
BARE_PLACES = ("méxico", "mexico", "cdmx", "ciudad de méxico")
COURT_PREFIXES = ("c. juez", "c juez", "juez de", "jueza de", "magistrado", "magistrada")
COMPANY_FORMS = ("s.a.", "s. de r.l", "s.a.p.i")

# Hints of the classifier, on text without accents.
ADDRESS_HINTS = (
    "calle", "avenida", "av.", "boulevard", "blvd", "col.", "colonia",
    "c.p.", "cp.", "codigo postal", "alcaldia", "delegacion", "piso",
    "depto", "departamento", "ciudad de", "fraccionamiento", "mz.", "lote",
)
LICENCE_HINTS = ("cedula profesional",)
ORGANIZATION_HINTS = ("s.a. de c.v", "s. de r.l", "persona moral", "razon social", "s.a.p.i", "s.a.b. de c.v")
IDENTIFIER_HINTS = (
    "nss", "seguro social", "pasaporte", "matricula", "folio",
    "licencia", "numero de empleado", "identificacion", "credencial",
    "clave de elector", "ine", "cic", "placas", "vin", "tarjeta",
    "nacido", "nacida", "expediente", "escritura publica",
)

# Limits.
MIN_ADDRESS, MIN_OTHER, MIN_SINGLE_ORGANIZATION, MIN_SINGLE_IDENTIFIER, MIN_PLAIN_IDENTIFIER = 12, 3, 5, 5, 10
MIN_CANDIDATE, MIN_MODEL_VALUE, MIN_STREET_CORE, MIN_REDACTABLE = 2, 3, 12, 2
CLASSIFY_SHARE = 0.65
CHUNK, CHUNK_OVERLAP = 1800, 200
MODEL_TIMEOUT_S = 35
PREVIEW = 2000
DEBOUNCE_MS = 400
MIN_EMBEDDED_TEXT = 40
MODEL_FIELDS = (
    ("names", "name", 24),
    ("organizations", "organization", 24),
    ("addresses", "address", 16),
    ("phones", "phone", 12),
    ("emails", "email", 12),
    ("cedulas", "cedula", 8),
    ("others", "identifier", 24),
)
EXTENSIONS = ("pdf", "txt", "text", "doc", "docx")
ERRORS = ("unsupportedFileType", "unreadablePDF", "unreadableWord", "emptyDocument", "readFailed")
OCR_SCALE, OCR_EDGE, OCR_ROW = 3.0, 2200.0, 0.02
