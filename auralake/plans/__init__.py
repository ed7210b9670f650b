from . import details, graphs, maps, measures, nested, records, relational, sounds, space, spatial, streams
