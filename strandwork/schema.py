"""Tables of a repository, and the constants of the model."""

from __future__ import annotations

#: Ids of the virtual nodes, the layer of edges without one, the strands.
START_NODE, END_NODE = 1, 2
NO_LAYER = -1
STRANDS = ("+", "-", ".", "?")
FILE_TYPES = ("gb", "fasta", "gfa", "gaf", "vcf", "changeset", "csv", "none")

#: Kinds of files by the last part of their names.
FILE_KINDS = {"gb": "gb", "gbk": "gb", "genbank": "gb", "fa": "fasta", "fasta": "fasta", "fna": "fasta", "gfa": "gfa", "gaf": "gaf", "vcf": "vcf", "csv": "csv", "changeset": "changeset"}

#: Data tables. Storage types are text and integer only.
TABLES = {
    "collections": "name string",
    "samples": "name string",
    "sequences": "hash string, sequence_type string, sequence string, name string, file_path string, length long",
    "nodes": "id long, sequence_hash string, hash string",
    "block_groups": "id long, collection_name string, sample_name string, name string",
    "paths": "id long, block_group_id long, name string",
    "edges": "id long, source_node_id long, source_coordinate long, source_strand string,"
    " target_node_id long, target_coordinate long, target_strand string",
    "path_edges": "id long, path_id long, index_in_path long, edge_id long",
    "block_group_edges": "id long, block_group_id long, edge_id long, chromosome_index long, phased long",
    "accessions": "id long, name string, path_id long, parent_accession_id long",
    "accession_edges": "id long, source_node_id long, source_coordinate long, source_strand string,"
    " target_node_id long, target_coordinate long, target_strand string, chromosome_index long",
    "accession_paths": "id long, accession_id long, index_in_path long, edge_id long",
}
#: Operation tables.
OPERATION_TABLES = {
    "operation": "hash string, db_uuid string, parent_hash string, branch_id long, change_type string",
    "operation_files": "id long, operation_hash string, file_addition_id long",
    "file_addition": "id long, file_path string, file_type string",
    "operation_summary": "id long, operation_hash string, summary string",
    "branch": "id long, db_uuid string, name string, start_operation_hash string, current_operation_hash string",
    "branch_masked_operations": "branch_id long, operation_hash string",
    "operation_state": "db_uuid string, operation_hash string, branch_id long",
    "defaults": "id long, db_name string, collection_name string, remote_url string",
}

EDGE_KEY = ["source_node_id", "source_coordinate", "source_strand", "target_node_id", "target_coordinate", "target_strand"]
#: What is unique in each table (null equals null).
KEYS = {
    "collections": ["name"],
    "samples": ["name"],
    "sequences": ["hash"],
    "nodes": ["hash"],
    "block_groups": ["collection_name", "sample_name", "name"],
    "paths": ["block_group_id", "name"],
    "edges": EDGE_KEY,
    "path_edges": ["path_id", "edge_id", "index_in_path"],
    "block_group_edges": ["block_group_id", "edge_id", "chromosome_index", "phased"],
    "accessions": ["name", "path_id", "parent_accession_id"],
    "accession_edges": [*EDGE_KEY, "chromosome_index"],
    "accession_paths": ["accession_id", "index_in_path", "edge_id"],
}
