"""The explicit schemas of the engine; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, D, L, I, TS = T.StringType(), T.BooleanType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TEXTS = T.ArrayType(S)

CANONICAL = struct(
    source=S, source_id=S, uuid_procedure=S,
    identity=struct(title=S, acheteur=S, url=S, region=S),
    lifecycle=struct(etat=S, nature=S, nature_label=S, annonce_lie=S, annonces_anterieures=S, publication_date=S, deadline=S),
    content=struct(description=S, keywords=TEXTS),
    classification=struct(type_marche=S, procedure=S, famille=S),
    metadata=struct(acheteur_email=S, acheteur_tel=S, acheteur_adresse=S, acheteur_cp=S, acheteur_ville=S, criteres=S, marche_public_simplifie=S, titulaire=S, siret=S),
)

#: One page of the bulletin; lists may come as scalars and are read as text.
RAW_FIELDS = struct(
    idweb=S, objet=S, nomacheteur=S, dateparution=S, datelimitereponse=S, nature_categorise=S, nature_libelle=S, url_avis=S, contractfolderid=S, etat=S,
    procedure_libelle=S, annonce_lie=S, annonces_anterieures=S, titulaire=S, famille_libelle=S, type_marche=S, code_departement=S, descripteur_libelle=S,
    criteres=S, marche_public_simplifie=S, donnees=S,
)
RAW_RECORD = T.StructType([*RAW_FIELDS.fields, T.StructField("fields", RAW_FIELDS), T.StructField("record", struct(fields=RAW_FIELDS))])

RSS_ITEM = struct(guid=S, link=S, title=S, description=S, contentSnippet=S, pubDate=S, date=S, dateAccepted=S, Location=S, creator=S, category=TEXTS)

TENDER = struct(
    source=S, source_id=S, uuid_procedure=S, title=S, description=S, keywords=TEXTS, acheteur=S, acheteur_email=S, budget_min=D, budget_max=D, deadline=S, publication_date=S,
    type_marche=S, region=S, url_ao=S, etat=S, siret=S, raw=CANONICAL,
)

RULE = struct(id=S, client_id=S, type=S, value=S, reason=S, feedback_id=S, active=B, created_at=TS)
FEEDBACK = struct(id=S, source_id=S, client_id=S, feedback=S, reason=S, correction_type=S, correction_value=S, chunk_content=S, agent_diagnosis=S, agent_proposal=S, status=S, source=S, created_by=S, chunk_vector_id=S, created_at=TS, processed_at=TS)
RUN = struct(id=S, client_id=S, since=T.DateType(), until=T.DateType(), source=S, status=S, started_at=TS, finished_at=TS)
MAIL_LOG = struct(client_id=S, since=S, until=S, email_type=S, recipients=TEXTS, high=L, medium=L, low=L, sent_at=TS)
LEXICON = struct(axis=S, category=S, weight=I, kind=S, term=S, ord=I)
REFERENCE_CLIENTS = struct(clients=T.ArrayType(struct(nom_normalise=S, aliases=TEXTS, secteur=S, type_org=S, region=S, statut=S, tags=TEXTS)))
VECTOR = struct(id=S, vector=T.ArrayType(T.FloatType()), text=S, type=S, secteur=S)
RETRY_JOB = struct(id=S, clientId=S, date=S, executeAt=S, delayMinutes=I, reason=S, status=S, createdAt=S, completedAt=S, error=S)
CHANGE = struct(field=S, old=S, new=S, amount=D)
SEMANTIC = struct(decision_gate=S, rejet_raison=S, recommandation=S, score_semantique_global=D, score_secteur=D, score_expertise=D, score_posture=D, reason=S, confidence=S)
CORPUS_CHUNK = struct(id=S, content=S, metadata=struct(type=S, secteur=S, decision=S, trigger_keywords=TEXTS), index=S)
EVAL_CASE = struct(id=S, ao=S, decision_expected=S, priority_expected=S, ia_correct=S, category=S, policy_expected=TEXTS, gap=S, notes=S)
USAGE = struct(promptTokens=L, completionTokens=L, totalTokens=L)
EVAL_RESULT = struct(id=S, category=S, expected_decision=S, actual_decision=S, expected_recommandation=S, actual_recommandation=S, decision_correct=B, priority_correct=B, rag_grounded=B, policy_cited=B, has_gap=B, old_ia_correct=S, score=D, usage=USAGE, error=S)

FEEDBACK_STATES = ("draft", "agent_proposed", "awaiting_confirm", "applied", "rejected", "deactivated")
RULE_TYPES = ("red_flag", "required_keyword")
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
