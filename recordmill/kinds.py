"""The record kinds that a store holds, as table descriptors. All per-kind behaviour hangs on these rows."""

from __future__ import annotations

from dataclasses import dataclass

BASE_IRI = "https://example.org/records"


@dataclass(frozen=True)
class Kind:
    name: str
    body: str  # column that holds the record's body
    folder: str
    namespace: str
    spec_field: str | None = None
    spec_kind: str | None = None


def _pair(name: str) -> list[Kind]:
    body = name.replace("-", "_")
    return [Kind(f"{name}-spec", f"{body}_spec", f"{name}-spec", "spec"), Kind(name, body, name, name, f"{body}_spec_id", f"{name}-spec")]


#: Kinds, in the order that decides which kind a record with several bodies has.
KINDS: tuple[Kind, ...] = (
    Kind("cell-spec", "cell_spec", "cell-spec", "spec"),
    Kind("cell", "cell_instance", "cell-instance", "cell", "cell_spec_id", "cell-spec"),
    Kind("test-protocol", "test_spec", "test-protocol", "spec"),
    Kind("test", "test", "test", "test"),
    Kind("dataset", "dataset", "dataset", "dataset"),
    *_pair("material"),
    *_pair("electrode"),
    *_pair("separator"),
    *_pair("current-collector"),
    *_pair("electrolyte"),
    *_pair("housing"),
    *_pair("equipment"),
    Kind("channel", "channel", "channel", "channel"),
    Kind("parameter-set", "parameter_set", "parameter-set", "spec"),
)
BY_NAME = {k.name: k for k in KINDS}


def kinds_in_namespace(namespace: str) -> list[str]:
    return [k.name for k in KINDS if k.namespace == namespace]


def iri(kind: str, uid: str) -> str:
    return f"{BASE_IRI}/{BY_NAME[kind].namespace}/{uid}"
