"""Tables and files in and out: series, stages, path layouts, label documents."""
