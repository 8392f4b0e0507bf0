"""File sources, file sinks and the shared scratch folder."""
