"""Row-local curation on a stream."""
