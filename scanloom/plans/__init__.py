"""Settings, registered queries, the IFC text and the whole run."""
