"""Contracts: the declared target fields, their spellings, and how they are inferred, read and written."""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from dataclasses import asdict, dataclass, field, replace

KINDS = ("identifier", "person_name", "email", "date", "enum", "text")
#: Which observed kinds a target kind takes.
COMPATIBLE = {
    "identifier": ("identifier", "text"),
    "person_name": ("person_name", "text"),
    "email": ("email",),
    "date": ("date",),
    "text": ("text", "enum", "person_name", "identifier"),
    "enum": ("enum", "text"),
}
MAX_FIELDS, MAX_SPEC_BYTES = 40, 256 * 1024
#: Words that stand for each other in headers.
VOCABULARY = {
    "employee": ("emp", "empl", "staff", "worker", "personnel", "associate"),
    "identifier": ("id", "no", "num", "number", "code", "ref"),
    "id": ("no", "num", "number", "code", "ref"),
    "name": ("nm", "nam"),
    "email": ("mail", "eml", "emailaddress", "mailid"),
    "phone": ("tel", "telephone", "mobile", "contact"),
    "date": ("dt", "on"),
    "department": ("dept", "div", "division", "team", "unit", "function"),
    "type": ("typ", "kind", "category", "cat"),
    "status": ("state", "stat"),
    "start": ("join", "joining", "joined", "hire", "hired", "commencement", "from"),
    "end": ("exit", "leaving", "left", "termination", "separation", "last", "to"),
    "work": ("office", "company", "business", "corporate", "official"),
    "full": ("complete", "legal", "display"),
    "employment": ("engagement", "contract", "job"),
    "first": ("fore", "given"),
    "last": ("sur", "family"),
    "amount": ("amt", "value", "total"),
    "address": ("addr", "location"),
    "city": ("town",),
    "country": ("nation",),
}
#: Headers of row numbers, which no contract takes as a field.
STRUCTURAL = {"sno", "srno", "serialno", "index", "rowid", "row", "no", "sl", "slno"}
#: Spellings shorter than this name too much.
MIN_SPELLING = 3
_FIELD_NAME = re.compile(r"^[A-Za-z][A-Za-z0-9_]{0,63}$")


def normal(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", header.lower())


def split_words(text: str) -> list[str]:
    """Words of a camel-cased or separated name, in lower case."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]


def field_words(name: str, label: str) -> list[str]:
    """The words of a field: those of its name, or of its label where the name is one word."""
    own = split_words(name)
    return own if len(own) > 1 else [w for w in re.split(r"[^a-z0-9]+", label.lower()) if w] or own


def derive_spellings(name: str, label: str) -> set[str]:
    """Headers that name a field without a declared alias: name, label, the last word alone, and the words with any of their
    stand-ins."""
    words = field_words(name, label)
    out = {normal(name), normal(label), *(normal("".join(w)) for w in itertools.product(*[(w, *VOCABULARY.get(w, ())) for w in words]))}
    if len(words) > 1:
        out.add(normal(words[-1]))
    return {s for s in out if len(s) >= MIN_SPELLING}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    label: str = ""
    required: bool = False
    identity: bool = False
    unique: bool = False
    aliases: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    value_aliases: dict = field(default_factory=dict)
    not_before: str | None = None
    max_length: int | None = None

    @property
    def title(self) -> str:
        return self.label or re.sub(r"^.", lambda m: m[0].upper(), " ".join(split_words(self.name)))

    def spellings(self) -> set[str]:
        return (derive_spellings(self.name, self.title) | {normal(a) for a in self.aliases}) - {""}


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]

    def __post_init__(self):
        names = [f.name for f in self.fields]
        problems = [
            (not names, "a contract needs a field"),
            (len(names) > MAX_FIELDS, f"more than {MAX_FIELDS} fields"),
            (len(set(names)) < len(names), "field names repeat"),
            (sum(f.identity for f in self.fields) > 1, "more than one identity field"),
            (any(f.kind not in KINDS for f in self.fields), "unknown kind"),
            (any(not _FIELD_NAME.match(n) for n in names), "malformed field name"),
            (any(f.not_before and f.not_before not in names for f in self.fields), "not_before names no field"),
            (any(f.kind == "enum" and not f.values for f in self.fields), "an enum needs values"),
        ]
        for bad, message in problems:
            if bad:
                raise ValueError(message)

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    @property
    def identity(self) -> Field | None:
        return next((f for f in self.fields if f.identity), None)

    @property
    def naming(self) -> Field | None:
        """The field that names a record for people."""
        tests = (lambda f: f.kind == "person_name", lambda f: f.identity, lambda f: f.kind == "identifier", lambda f: f.required)
        return next((f for test in tests for f in self.fields if test(f)), None)

    def spelling_index(self) -> dict[str, list[str]]:
        """Fields of each spelling; two or more make it ambiguous."""
        out: dict[str, list[str]] = {}
        for f in self.fields:
            for s in sorted(f.spellings()):
                out.setdefault(s, []).append(f.name)
        return out

    def json_schema(self) -> dict:
        """The delivered record as JSON Schema."""
        properties = {}
        for f in self.fields:
            p: dict = {"type": "string" if f.required else ["string", "null"]}
            if f.kind == "identifier":
                p |= {"minLength": 1, "maxLength": 64, "pattern": "^[A-Za-z0-9][A-Za-z0-9._/-]*$"}
            elif f.kind == "person_name":
                p |= {"minLength": 1, "maxLength": 200}
            elif f.kind == "email":
                p |= {"format": "email", "maxLength": 254}
            elif f.kind == "date":
                p |= {"format": "date"}
            elif f.kind == "enum":
                p |= {"enum": [*f.values, *([] if f.required else [None])]}
            else:
                p |= {"maxLength": 500}
            if f.max_length is not None and f.kind != "enum":
                p["maxLength"] = f.max_length
            properties[f.name] = p
        return {"type": "object", "additionalProperties": False, "properties": properties, "required": sorted(f.name for f in self.fields if f.required)}


ORDER = Contract(
    "Order",
    (
        Field("orderRef", "identifier", "Order ref", required=True, identity=True, aliases=("order number",)),
        Field("customerEmail", "email", "Customer email", required=True, unique=True, aliases=("client email",)),
        Field("placedDate", "date", "Placed date", required=True),
        Field("shippedDate", "date", "Shipped date", not_before="placedDate", aliases=("dispatched date",)),
        Field(
            "tier", "enum", "Tier", values=("urgent", "high", "medium", "not_specified", "low"),
            value_aliases={"1urgent": "urgent", "2high": "high", "3medium": "medium", "4notspecified": "not_specified", "5low": "low"}, aliases=("priority",),
        ),
    ),
)
#: Headers that name either date of employment, and the spellings of its kinds.
_EITHER_DATE = ("dates", "employmentdate", "effectivedate", "contractdate")
_EMPLOYMENT = {
    "fulltime": "full_time", "full": "full_time", "permanent": "full_time", "fte": "full_time", "regular": "full_time",
    "parttime": "part_time", "part": "part_time",
    "contract": "contract", "contractor": "contract", "contractual": "contract", "temporary": "contract", "temp": "contract", "fixedterm": "contract",
    "intern": "intern", "internship": "intern", "trainee": "intern", "apprentice": "intern",
}
#: The contract of an employee record, with its aliases.
EMPLOYEE = Contract(
    "Employee",
    (
        Field(
            "employeeId", "identifier", "Employee ID", required=True, identity=True,
            aliases=("employeeid", "empid", "employeenumber", "empno", "employeecode", "empcode", "staffid", "staffnumber", "personnelnumber", "workerid", "id"),
        ),
        Field(
            "fullName", "person_name", "Full name", required=True, max_length=200,
            aliases=("fullname", "name", "employeename", "empname", "empnm", "staffname", "displayname", "legalname", "completename"),
        ),
        Field(
            "workEmail", "email", "Work email", required=True, unique=True,
            aliases=("workemail", "email", "emailaddress", "officeemail", "companyemail", "businessemail", "corporateemail", "workmail"),
        ),
        Field(
            "startDate", "date", "Start date", required=True,
            aliases=("startdate", "joindate", "joiningdate", "dateofjoining", "doj", "hiredate", "datehired", "employmentstartdate", "commencementdate", *_EITHER_DATE),
        ),
        Field(
            "endDate", "date", "End date", not_before="startDate",
            aliases=("enddate", "exitdate", "leavingdate", "dateofleaving", "dol", "terminationdate", "lastworkingday", "lastdate", "separationdate", "employmentenddate", *_EITHER_DATE),
        ),
        Field("department", "text", "Department", max_length=120, aliases=("department", "dept", "departmentname", "division", "team", "businessunit", "function", "orgunit")),
        Field(
            "employmentType", "enum", "Employment type", values=("full_time", "part_time", "contract", "intern"), value_aliases=_EMPLOYMENT,
            aliases=("employmenttype", "emptype", "employeetype", "contracttype", "workertype", "employmentstatus", "engagementtype"),
        ),
    ),
)

#: Type and format words of specifications.
_TYPE_WORDS = {"date": "date", "datetime": "date", "timestamp": "date", "date-time": "date", "email": "email", "identifier": "identifier", "id": "identifier", "uuid": "identifier", "enum": "enum", "person_name": "person_name"}
_NAME_WORDS = {"id": "identifier", "identifier": "identifier", "ref": "identifier", "reference": "identifier", "code": "identifier", "number": "identifier", "no": "identifier", "tag": "identifier", "email": "email", "mail": "email", "date": "date", "on": "date", "at": "date", "day": "date", "name": "person_name"}


def _field_of(name: str, spec, required: set[str]) -> tuple[Field, list[str]]:
    spec = {"type": spec} if isinstance(spec, str) else dict(spec or {})
    notes: list[str] = []
    types = spec.get("type")
    words = [str(t).lower() for t in (types if isinstance(types, list) else [types]) if t and t != "null"]
    values = tuple(str(v) for v in spec.get("enum", spec.get("values", ())) if v is not None)
    fmt, kind = str(spec.get("format", "")).lower(), str(spec.get("kind", "")).lower()
    if kind in KINDS:
        found = kind
    elif values:
        found = "enum"
    elif fmt in _TYPE_WORDS or words and words[0] in _TYPE_WORDS:
        found = _TYPE_WORDS.get(fmt) or _TYPE_WORDS[words[0]]
    else:
        last = (split_words(name) or [""])[-1]
        found = _NAME_WORDS.get(last, "text") if not kind else "text"
        if found != "text":
            notes.append(f"{name}: taken as {found} from its name")
    if found == "enum" and not values:
        found = "text"
    made = Field(
        name, found, str(spec.get("label") or spec.get("title") or ""), bool(spec.get("required") is True or name in required), bool(spec.get("identity")), bool(spec.get("unique")),
        tuple(spec.get("aliases", ())), values, dict(spec.get("value_aliases", {})), spec.get("not_before"), spec.get("max_length", spec.get("maxLength")),
    )
    return made, notes


def parse_spec(text: str) -> tuple[Contract, list[str]]:
    """A contract from JSON or YAML: ``fields`` or ``columns`` (list or map), JSON Schema ``properties``, or a bare map; with what was assumed."""
    if len(text.encode()) > MAX_SPEC_BYTES:
        raise ValueError("the specification is too large")
    try:
        doc = json.loads(text)
    except ValueError:
        import yaml

        doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise ValueError("a specification is a map")
    required = {x for x in doc.get("required", ()) if isinstance(x, str)} if isinstance(doc.get("required"), list) else set()
    body = doc.get("fields", doc.get("columns", doc.get("properties")))
    if body is None:
        body = {k: v for k, v in doc.items() if k not in ("name", "title", "required", "type", "$schema")}
    entries = list(body.items()) if isinstance(body, dict) else [(x, {}) if isinstance(x, str) else (x["name"], x) for x in body]
    fields, notes = [], []
    skipped = sorted(n for n, _ in entries if not _FIELD_NAME.match(str(n)))
    if skipped:
        notes.append("skipped: " + ", ".join(skipped[:5]))
    for name, spec in entries:
        if _FIELD_NAME.match(str(name)):
            made, more = _field_of(name, spec, required)
            fields.append(made)
            notes += more
    if not any(f.identity for f in fields):
        chosen = next((f.name for f in fields if f.required and f.kind == "identifier"), None)
        if chosen:
            fields = [replace(f, identity=f.name == chosen) for f in fields]
            notes.append(f"{chosen}: taken as identity")
    if not any(f.unique for f in fields):
        chosen = next((f.name for f in fields if f.required and f.kind == "email"), None)
        if chosen:
            fields = [replace(f, unique=f.name == chosen) for f in fields]
            notes.append(f"{chosen}: taken as unique")
    return Contract(str(doc.get("name") or doc.get("title") or "Imported"), tuple(fields)), notes


def to_spec(contract: Contract) -> dict:
    """The own format, without loss; spellings that can be derived stay out."""
    rows = []
    for f in contract.fields:
        row = {k: v for k, v in asdict(f).items() if v not in ("", False, None, (), {})}
        rows.append({k: list(v) if isinstance(v, tuple) else v for k, v in row.items()})
    return {"name": contract.name, "fields": rows}


def to_yaml(contract: Contract) -> str:
    import yaml

    return yaml.safe_dump(to_spec(contract), sort_keys=False, allow_unicode=True)


def ascii_fold(text: str) -> str:
    out = []
    for c in unicodedata.normalize("NFKD", text):
        if not unicodedata.combining(c):
            out.append(c if c.isascii() else "".join(x for x in c.casefold() if x.isascii()))
    return "".join(out)


def field_name(header: str, taken: set[str]) -> str:
    words = re.findall(r"[A-Za-z0-9]+", ascii_fold(header)) or ["field"]
    name = words[0].lower() + "".join(w[:1].upper() + w[1:].lower() for w in words[1:])
    name = (name if name[0].isalpha() else f"field{name}")[:64]
    return next(n for n in (name, *(f"{name[:61]}{i}" for i in range(2, 100))) if n not in taken)


def header_label(header: str) -> str:
    """A header as words with capitals, as a reader would write it."""
    words = re.split(r"[\s_\-./\\|]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", header.strip()))
    return " ".join(w[:1].upper() + w[1:] for w in words if w)


def infer_contract(profiles: list[dict], name: str = "Detected") -> Contract:
    """From column profiles (header, kinds in order of detection). Never infers required, identity, unique or enum."""
    fields, seen, taken = [], set(), set()
    for i, p in enumerate(profiles):
        key = normal(p["header"]) or f"#{i}"
        if key in seen or key in STRUCTURAL or len(fields) == MAX_FIELDS:
            continue
        seen.add(key)
        made = field_name(p["header"], taken)
        taken.add(made)
        kind = (p["kinds"] or ["text"])[0]
        fields.append(Field(made, "text" if kind == "enum" else kind, header_label(p["header"])))
    return Contract(name, tuple(fields) or (Field("field1"),))
