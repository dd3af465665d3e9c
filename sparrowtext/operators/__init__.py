"""Field model, index building, search, dictionary and facet operators."""
