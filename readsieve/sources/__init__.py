"""Readers: FASTA/FASTQ files and parquet tables."""
