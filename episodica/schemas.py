"""Explicit schemas of the engine's tables; readers never infer."""

from __future__ import annotations

from pyspark.sql.types import StructType

FRAMES = StructType.fromDDL("ep bigint, step int, is_demo boolean, sg string, sg_online string, task_idx int, image binary")
DETECTIONS = StructType.fromDDL("ep bigint, step int, dets array<struct<name:string,r:int,c:int,score:double>>")
EVENTS = StructType.fromDDL("ep bigint, t int, kind string, prefix string, sg string, line string, ord int")
MOTION = StructType.fromDDL("ep bigint, t int, kind string, color string, r int, c int, site_r int, site_c int")
WRITER = StructType.fromDDL("instruction string, family string, ep bigint, span array<int>, phase string, frames array<string>, frame_dets array<string>, bank array<string>, expected_next string, target string, offset int")
REASONER = StructType.fromDDL("instruction string, family string, ep bigint, tq int, phase string, bank array<string>, target string, offset int, frames array<string>, frame_det string, target_oracle string")
ROLLOUT = StructType.fromDDL("ep bigint, tq int, family string, gt string, pred string")
TRACE = StructType.fromDDL("kind string, ep bigint, task string, step int, tick int, expected_in string, oracle string, agent1_out string, agent2_out string, bank array<string>, dets array<array<string>>, n_demo int, bank_after_demo array<string>, success string")
DIAG = StructType.fromDDL("task string, ep int, count int, pred string, oracle string")
STATE = StructType.fromDDL("ep bigint, step int, s array<double>")
SEGMENTS = StructType.fromDDL("ep bigint, seg_start array<int>, seg_len array<int>, instructions array<string>")
PLAN = StructType.fromDDL("task int, ord int, instr string, kind string, obj string, median array<int>, iqr array<double>")
PRIOR = StructType.fromDDL("key string, median double, p10 double, p90 double, n int")
KEYFRAMES = StructType.fromDDL("task string, local_ep int, j int, t int, subgoal string, r int, c int, valid boolean")
TOKENS = StructType.fromDDL("ep bigint, tok_idx int, from_step int, until_step int, emb array<float>")
SUMMARY = StructType.fromDDL("task_id int, tsr double, csr double")
CLAIMS = StructType.fromDDL("ep string, tick int, step int, kind string, text string, fired int, refuted boolean")
