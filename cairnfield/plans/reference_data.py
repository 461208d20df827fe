"""Reference tables. Larger catalogs (codes, medications) are inputs, read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Protocols by code (reference, exams, suggested actions, interaction flag).
PROTOCOLS = {
    "L40.5": ("PCDT Artrite Psoriásica - CONITEC 2023", ["Hemograma completo", "Contagem de plaquetas", "Creatinina sérica", "AST/TGO", "ALT/TGP"], [("exam", "Solicitar Hemograma completo"), ("exam", "Solicitar Contagem de plaquetas"), ("exam", "Solicitar Creatinina sérica"), ("exam", "Solicitar AST/TGO"), ("exam", "Solicitar ALT/TGP"), ("observation", "Avaliar acometimento cutâneo (PASI)"), ("review", "Reavaliação em 24h")], False),
    "A41.9": ("Protocolo de Sepse - MS 2019", ["Hemoculturas (2 amostras)", "Lactato sérico", "Hemograma completo", "PCR e Procalcitonina", "Gasometria arterial", "Creatinina e Ureia"], [("prescription", "Antibioticoterapia empírica em até 1h (ver protocolo)"), ("exam", "Coletar hemoculturas antes dos antibióticos"), ("observation", "Monitorar sinais de disfunção orgânica"), ("review", "Reavaliação em 6h - bundle de sepse")], False),
    "T81.4": ("Protocolo Pós-Cirúrgico - Controle de Infecção", ["Hemograma completo", "PCR", "Cultura de sítio cirúrgico", "Glicemia"], [("prescription", "Verificar interação: antibiótico + anticoagulante em uso"), ("exam", "Solicitar cultura de sítio cirúrgico"), ("observation", "Inspecionar ferida operatória")], True),
    "M05.3": ("Diretriz Artrite Reumatoide - CFM/MS (referência mock)", ["Hemograma completo", "PCR (ves)", "Fator reumatoide e anti-CCP", "Função hepática (TGO/TGP)", "Creatinina"], [("exam", "Solicitar PCR e autoanticorpos"), ("exam", "Avaliar marcadores de atividade de doença"), ("prescription", "Avaliar dmard de acordo com protocolo institucional"), ("review", "Reavaliação ambulatorial em 4-8 semanas")], False),
}
# What other codes get.
DEFAULT_PROTOCOL = {"protocol_ref": "Protocolo institucional genérico (mock)", "exams": ["Hemograma completo", "Creatinina sérica"], "actions": [("exam", "Solicitar exames basais conforme protocolo"), ("review", "Reavaliação clínica em 24-48h")]}

# First quick question by code, prefixes that stand for a code.
QUICK_QUESTIONS = {
    "L40.5": ["Quais exames estão pendentes?", "Há contraindicação ao metotrexato neste paciente?", "Qual o protocolo recomendado para artrite psoriásica?", "Resumir o caso clínico atual"],
    "A41.9": ["Quais exames estão pendentes?", "Bundle de sepse está completo?", "Qual antibiótico empírico recomendar?", "Paciente apresenta critérios de UTI?"],
    "default": ["Quais exames estão pendentes?", "Resumir o caso clínico atual", "Há alertas ativos?", "Qual a ação sugerida?"],
}
QUICK_PREFIXES = {"L40": "L40.5", "A41": "A41.9"}

# Comorbidities (code, label, category), in their order.
COMORBIDITIES = [
    ("HAS", "Hipertensão Arterial Sistêmica", "cardiovascular"),
    ("DM2", "Diabetes Mellitus Tipo 2", "endocrine"),
    ("DM1", "Diabetes Mellitus Tipo 1", "endocrine"),
    ("IRC", "Insuficiência Renal Crônica", "renal"),
    ("DRC-Dialise", "Doença Renal Crônica em Diálise", "renal"),
    ("IC", "Insuficiência Cardíaca", "cardiovascular"),
    ("DAC", "Doença Arterial Coronariana", "cardiovascular"),
    ("AVC-Previo", "Acidente Vascular Cerebral Prévio", "neurological"),
    ("FAi", "Fibrilação Atrial", "cardiovascular"),
    ("Asma", "Asma", "respiratory"),
    ("DPOC", "Doença Pulmonar Obstrutiva Crônica", "respiratory"),
    ("Obesidade", "Obesidade", "metabolic"),
    ("Hepatopatia", "Doença Hepática Crônica", "hepatic"),
    ("Autoimune", "Doença Autoimune", "immunological"),
    ("Imunossuprimido", "Imunossupressão", "immunological"),
    ("HIV", "HIV", "infectious"),
    ("Cancer", "Câncer Ativo", "oncological"),
    ("Tabagismo", "Tabagismo", "behavioral"),
    ("Etilismo", "Etilismo Crônico", "behavioral"),
    ("Gravidez", "Gravidez", "reproductive"),
    ("Puerperio", "Puerpério", "reproductive"),
    ("Outras", "Outras Comorbidades", "other"),
]

# Diagnosis codes where no code library is given, in their order.
DIAGNOSES = [
    ("L40.5", "Artrite Psoriásica"),
    ("A41.9", "Sepse não especificada"),
    ("T81.4", "Infecção pós-procedimento cirúrgico"),
    ("E11.9", "Diabetes Mellitus tipo 2 sem complicações"),
    ("I10", "Hipertensão Essencial"),
    ("J18.9", "Pneumonia não especificada"),
    ("N17.9", "Insuficiência Renal Aguda"),
    ("K92.1", "Melena"),
    ("I63.9", "AVC Isquêmico"),
    ("M05.3", "Artrite Reumatoide"),
    ("I50.0", "Insuficiência Cardíaca Congestiva"),
    ("B34.9", "Infecção viral não especificada"),
    ("R50.9", "Febre não especificada"),
    ("R06.02", "Dispneia de repouso"),
    ("D64.9", "Anemia não especificada"),
    ("E87.1", "Hiponatremia"),
    ("R57.0", "Choque cardiogênico"),
    ("T78.4", "Alergia não especificada"),
    ("Z87.891", "História pessoal de alergia a medicamentos"),
    ("K85.9", "Pancreatite aguda"),
    ("C50.9", "Neoplasia maligna da mama"),
    ("G43.9", "Enxaqueca"),
]


def protocols(spark: SparkSession) -> DataFrame:
    rows = [(c, r, e, [{"type": t, "description": d} for t, d in a], i) for c, (r, e, a, i) in PROTOCOLS.items()]
    return spark.createDataFrame(rows, "code string, protocol_ref string, exams array<string>, actions array<struct<type: string, description: string>>, interaction boolean")


def quick_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, "|".join(q)) for c, q in QUICK_QUESTIONS.items()], "code string, answer string")


def comorbidities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(COMORBIDITIES)], "ordinal int, code string, label string, category string")


def diagnoses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(DIAGNOSES)], "ordinal int, code string, label string")
