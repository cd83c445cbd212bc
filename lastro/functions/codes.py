"""Fiscal code tables and their decoding. An unknown code passes through unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the official code lists.
INVOICE_DIRECTION = {"0": "Entrada", "1": "Saída"}
OPERATION_SCOPE = {"1": "Interna", "2": "Interestadual", "3": "Exterior"}
TAX_REGIME = {"1": "Simples Nacional", "3": "Regime Normal"}
FREIGHT_MODE = {
    "0": "Remetente",
    "1": "Destinatário",
    "2": "Terceiros",
    "3": "Transporte próprio remetente",
    "4": "Transporte próprio Destinatário",
    "9": "Sem Transporte",
}
FREIGHT_DOCUMENT_TYPE = {"0": "CTE Normal", "1": "CTe Complemento", "3": "CTe Substituto"}
FREIGHT_SERVICE = {
    "0": "Normal",
    "1": "Subcontratação",
    "2": "Redespacho",
    "3": "Redespacho intermediário",
    "4": "Serviço Vinculado à Multimodal",
}
YES, NO = "Sim", "Não"


def decoded(code: Column, table: dict[str, str]) -> Column:
    label = None
    for key, text in table.items():
        label = F.when(code == key, F.lit(text)) if label is None else label.when(code == key, F.lit(text))
    return label.otherwise(code)
