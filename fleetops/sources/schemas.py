"""Fixed schemas of the job-record tables. JSON columns stay text; times of day are local strings, or epoch seconds."""

from __future__ import annotations

SCHEMAS = {
    "batches": "id string, name string, mode string, status string, created_at string, project string, priority long, revision long, failure_policy string, force_rerun boolean, cwd string, env map<string,string>, notify string, depends_on array<string>, depends_on_exact array<struct<instance_id:string,batch_id:string,tasks:array<struct<task_id:string,version:long,job_id:string,spec_sha256:string,fingerprint:string>>>>, row_seq long",
    "tasks": "batch_id string, id string, version long, spec string, order_idx long, project string, row_seq long",
    "jobs": "id string, batch_id string, task_id string, version long, status string, gpu int, pgid long, kill_reason string, rc int, failure string, retries long, fingerprint string, git_rev string, submitted_at string, started_at string, finished_at string, project string, progress string, allocation_id string, row_seq long",
    "gpus": "idx int, status string, job_id string, quarantined int, ignore_until string, updated_at string, mem_total_gib double, revision long",
    "gpu_jobs": "gpu_id int, job_id string, vram_gib double, updated_at string",
    "profile_cache": "profile_key string, peak_gib double, updated_at string, git_rev string",
    "projects": "name string, gpu_quota long, gpu_enabled boolean, priority long, gpu_affinity array<int>, gpu_affinity_hard boolean, colocate boolean, max_jobs int, root string",
    "incidents": "id long, ts string, kind string, gpu_idx int, job_id string, batch_id string, payload string",
    "events": "owner string, seq long, kind string, id string, prev_id string, payload string, observed_at string",
}

#: One submitted document; what can't be read is kept in _corrupt.
BATCH_SPEC = (
    "name string, project string, mode string, priority long, cwd string, env map<string,string>, depends_on array<string>, failure_policy string, force_rerun boolean, "
    "sweep struct<matrix:map<string,array<string>>,max_parallel:int>, tasks array<struct<id:string,cmd:array<string>,duration_min:double,max_retry:long,resources:struct<gpu:long,cpus:long,gpu_share:boolean,vram_gib:double,host_mem_gib:double,disk_gib:double>,artifacts:map<string,map<string,string>>>>, _corrupt string"
)

#: A telemetry line: memory in MiB, use in percent; empty where the probe couldn't tell.
SAMPLE = "ts string, node string, idx int, total_mib long, used_mib long, free_mib long, util int, pid long, uuid string"
INVENTORY = "idx int, uuid string, pci string, compute_mode string, mig_mode string"
