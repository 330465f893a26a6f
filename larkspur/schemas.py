"""Record types and fixed values of the evaluation model."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels of the position grid, run names, tasks and fillers.
GRID = ("p000", "p010", "p025", "p050", "p075", "p090", "p100")
POSITIONS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
RUNS = ("base", "independent_answer", "independent_evidence_id", "independent_evidence", "paired_answer", "paired_evidence_id", "paired_evidence")
TASKS = ("kv", "two_hop")
FILLERS = ("neutral", "same_format", "answer_bearing")
METRICS = ("valid_json", "answer_correct", "evidence_ids_correct", "evidence_quotes_correct", "all_predicted_quotes_supported")
#: The flag that says whether a metric applies to a row; the others always do.
APPLICABLE = {"evidence_ids_correct": "evidence_ids_applicable", "evidence_quotes_correct": "evidence_quotes_applicable", "all_predicted_quotes_supported": "all_predicted_quotes_supported_applicable"}

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SEED = T.DecimalType(20, 0)
TARGET = struct(answer=S, answers=T.ArrayType(S), evidence_ids=T.ArrayType(S), evidence_quotes=T.ArrayType(S), confidence=D)
SAMPLE = struct(schema_version=S, sample_id=S, group_id=S, split=S, task=S, filler_type=S, query_position=S, target_tokens=I, actual_tokens=I, target_position=D, actual_position=D, position_label=S, seed=SEED, tokenizer=S, system_prompt=S, prompt=S, evaluation_mode=S, target=TARGET, metadata=struct(filler_fingerprint=S, filler_document_count=I, evidence_document_count=I, evidence_clustered=B, insertion_document_index=I, fact_fingerprint=S, training_design=S, fact_id=S, fact_index=I, replica_index=I, fact_seed=SEED, filler_seed=SEED))
PARSED = struct(answer=S, evidence_ids=T.ArrayType(S), evidence_quotes=T.ArrayType(S), confidence=D)
RESULT = struct(schema_version=S, run_name=S, evaluation_mode=S, sample_id=S, group_id=S, task=S, filler_type=S, target_tokens=I, position_label=S, target_position=D, actual_position=D, target=TARGET, generated_text=S, finish_reason=S, output_tokens=I, batch_wall_seconds=D, valid_json=B, answer_metric=S, answer_score=D, answer_correct=B, evidence_ids_applicable=B, evidence_ids_correct=B, evidence_quotes_applicable=B, evidence_quotes_correct=B, all_predicted_quotes_supported_applicable=B, all_predicted_quotes_supported=B, parsed=PARSED)
MESSAGE = struct(role=S, content=S)
SFT = struct(schema_version=S, id=S, messages=T.ArrayType(MESSAGE), metadata=struct(variant=S, raw_sample_id=S, group_id=S, task=S, filler_type=S, target_tokens=I, actual_tokens=I, target_position=D, actual_position=D, position_label=S, fact_id=S, replica_index=I, pairing_mode=S, supervision_mode=S))
TOKENS = struct(row_index=L, input_ids=T.ArrayType(I), completion_mask=T.ArrayType(T.ByteType()))
HISTORY = struct(variant=S, step=I, epoch=D, loss=D, grad_norm=D, learning_rate=D, entropy=D, num_tokens=D, mean_token_accuracy=D, eval_loss=D)
IFEVAL = struct(sample_id=S, key=I, instruction_id_list=T.ArrayType(S), strict_follow_all=B, strict_follow_list=T.ArrayType(B), loose_follow_all=B, loose_follow_list=T.ArrayType(B))

#: Version tags and what a reader of each expects.
SCHEMAS = {"position-group-v1": SAMPLE, "position-group-v2": SAMPLE, "position-eval-result-v1": RESULT, "position-sft-v1": SFT, "position-sft-v2": SFT}
